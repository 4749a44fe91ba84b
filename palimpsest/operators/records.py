"""Tagging, generation and inference records, and model rows.

Records are built from ``tokens`` (start token first) and ``ops`` (one op list
per token) as ordered fragments, so no positions shift.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules, tags
from ..functions.collections import argmax, bind, bound, index_range, run_bounds

ITEM = "array<struct<token:string,mask:int>>"


def _item(token: Column, mask: int) -> Column:
    return F.struct(token.alias("token"), F.lit(mask).alias("mask"))


def _items(*pairs: tuple) -> Column:
    return F.array(*[_item(F.lit(t) if isinstance(t, str) else t, m) for t, m in pairs])


def _none() -> Column:
    return F.array().cast(ITEM)


def _plain(words: Column, mask: int = 0) -> Column:
    return F.transform(words, lambda w: _item(w, mask))


def _is(op: Column, start: str) -> Column:
    return F.coalesce(F.startswith(op, F.lit(start)), F.lit(False))


def _appended(ops: Column) -> Column:
    kept = F.filter(ops, lambda o: _is(o, rules.APPEND))
    return F.transform(kept, lambda o: _item(F.substring(o, len(rules.APPEND) + 1, 1 << 30), 1))


_KEEP, _MERGE, _DELETE, _VERB, _TRANSFORM, _REPLACE, _APPEND, _LIKE_DELETE = range(8)


def _kinds(firsts: Column, replace: str = rules.REPLACE, append: str = rules.APPEND) -> Column:
    """A number per first op: the fragments look at their neighbours' too, and
    comparing numbers costs far less than comparing starts of strings."""
    return F.transform(
        firsts,
        lambda f: F.when(_is(f, "$MERGE_"), _MERGE)
        .when(f == rules.DELETE, _DELETE)
        .when(_is(f, rules.VERB), _VERB)
        .when(_is(f, "$TRANSFORM"), _TRANSFORM)
        .when(_is(f, replace), _REPLACE)
        .when(_is(f, append), _APPEND)
        .when(_is(f, rules.DELETE), _LIKE_DELETE)
        .otherwise(_KEEP),
    )


def _by_run(x: Column, single: Callable[[Column, Column], Column], merged: Callable[[Column, Column, Column], Column]) -> Column:
    """Items of all tokens, run by run: a run is one token, or tokens marked to be
    merged with the one after them. ``x`` has tokens ``t``, first ops ``f`` and
    their kinds ``k``; ``single(i, kind)`` and ``merged(lo, hi, item)`` give a
    run's items."""
    toks, firsts, kinds = x["t"], x["f"], x["k"]

    def item(lo: Column, hi: Column) -> Column:
        glue = F.when(_is(F.get(firsts, lo), rules.MERGE_HYPHEN), F.lit("-")).otherwise(F.lit(""))
        return _items((F.call_function("array_join", F.slice(toks, lo + 1, hi - lo + 1), glue), 0))

    def run(starts: Column) -> Column:
        def one(lo: Column, number: Column) -> Column:
            last = F.coalesce(F.get(starts, number + 1), F.size(kinds)) - 1
            joined = bind(last, lambda hi: merged(lo, hi, item(lo, hi)))
            kind = F.get(kinds, lo)
            return F.when(kind == _MERGE, joined).otherwise(single(lo, kind))

        return F.flatten(F.transform(starts, one))

    return bind(F.filter(index_range(F.size(kinds)), lambda i: (i == 0) | (F.get(kinds, i - 1) != _MERGE)), run)


def has_generation_op(ops: Column, include_verb: bool = False) -> Column:
    """Any replaced or appended word (or, on request, a verb transform)."""
    starts = ["$REPLACE", "$APPEND"] + ([rules.VERB] if include_verb else [])

    def any_start(o: Column) -> Column:
        hit = F.lit(False)
        for s in starts:
            hit = hit | F.startswith(o, F.lit(s))
        return hit

    return F.exists(ops, lambda own: F.exists(own, any_start))


def tagging_record(line: Column) -> Column:
    """``struct<tokens, action_tags>`` of a tagged line, one tag per token."""
    return bind(
        tags.parse_tagged_line(line),
        lambda p: F.struct(
            p["tokens"].alias("tokens"), tags.one_tag_per_token(p["ops"]).alias("action_tags")
        ),
    )


def generation_record(tokens: Column, ops: Column, keep_delete: bool = True) -> Column:
    """``array<struct<token, mask>>``; mask 1 marks words to be generated.

    A run of deleted tokens shares one bracket pair; a deleted token that also
    appends words closes its run so the words stand in place.
    """

    def build(x: Column) -> Column:
        toks, all_ops, firsts, kinds = x["t"], x["o"], x["f"], x["k"]

        def deletes(i: Column) -> Column:
            return F.get(kinds, i).isin(_DELETE, _LIKE_DELETE)

        def single(i: Column, kind: Column) -> Column:
            tok, first, o = F.get(toks, i), F.get(firsts, i), F.get(all_ops, i)
            prev_open = (
                deletes(i - 1)
                & (F.size(F.get(all_ops, i - 1)) == 1)
                & F.coalesce(F.get(kinds, i - 2) != _MERGE, F.lit(True))  # that token went into a merged run
            )
            next_joins = deletes(i + 1) & (F.size(o) == 1)
            opened, closed = F.coalesce(prev_open, F.lit(False)), F.coalesce(next_joins, F.lit(False))
            bare = _items((tok, 0))
            deleted = (
                F.when(opened & closed, bare)
                .when(opened, _items((tok, 0), (rules.DELETE_CLOSE, 0)))
                .when(closed, _items((rules.DELETE_OPEN, 0), (tok, 0)))
                .otherwise(_items((rules.DELETE_OPEN, 0), (tok, 0), (rules.DELETE_CLOSE, 0)))
                if keep_delete
                else _none()
            )
            verb = _items(
                (rules.VERB_OPEN, 0),
                (tok, 0),
                (rules.VERB_CLOSE, 0),
                (F.substring(first, len(rules.VERB) + 1, 1 << 30), 1),
            )
            new_word = (F.substring(first, len(rules.REPLACE) + 1, 1 << 30), 1)
            replaced = (
                _items((rules.DELETE_OPEN, 0), (tok, 0), (rules.DELETE_CLOSE, 0), new_word)
                if keep_delete
                else _items(new_word)
            )
            own = (
                F.when(kind.isin(_KEEP, _APPEND, _LIKE_DELETE), bare)
                .when(kind == _DELETE, deleted)
                .when(kind == _REPLACE, replaced)
                .when(kind == _VERB, verb)
                .otherwise(_plain(tags.apply_tag(tok, first)))
            )
            return F.when((F.size(o) == 1) & (kind != _APPEND), own).otherwise(F.concat(own, _appended(o)))

        def merged(lo: Column, hi: Column, item: Column) -> Column:
            inside = F.flatten(F.transform(F.slice(all_ops, lo + 1, hi - lo), _appended))
            return F.concat(inside, item, _appended(F.get(all_ops, hi)))

        return _by_run(x, single, merged)

    firsts = F.transform(ops, lambda o: F.get(o, F.lit(0)))
    return bind(
        F.struct(tokens.alias("t"), ops.alias("o"), firsts.alias("f")),
        lambda x: bind(F.struct(x["t"], x["o"], x["f"], _kinds(x["f"]).alias("k")), build),
    )


def inference_record(tokens: Column, tags_: Column, slots: int = 4, keep_delete: bool = True) -> Column:
    """Like ``generation_record`` from one predicted tag per token; every place
    to be written is ``slots`` mask tokens."""
    masks = [(rules.MASK, 1)] * slots

    def build(x: Column) -> Column:
        toks, all_tags = x["t"], x["f"]

        def single(i: Column, kind: Column) -> Column:
            tok, tag = F.get(toks, i), F.get(all_tags, i)
            bracket = [(rules.DELETE_OPEN, 0), (tok, 0), (rules.DELETE_CLOSE, 0)] if keep_delete else []

            def made(*pairs: tuple) -> Column:
                return _items(*pairs) if pairs else _none()

            return (
                F.when(kind.isin(_KEEP, _LIKE_DELETE), _items((tok, 0)))
                .when(kind == _DELETE, made(*bracket))
                .when(kind == _VERB, _items((rules.VERB_OPEN, 0), (tok, 0), (rules.VERB_CLOSE, 0), *masks))
                .when(kind == _TRANSFORM, _plain(tags.apply_tag(tok, tag)))
                .when(kind == _REPLACE, made(*bracket, *masks))
                .otherwise(_items((tok, 0), *masks))
            )

        return _by_run(x, single, lambda lo, hi, item: item)

    plain = F.transform(tags_, lambda t: F.regexp_replace(t, "^B-", ""))
    return bind(
        F.struct(tokens.alias("t"), plain.alias("f")),
        lambda x: bind(F.struct(x["t"], x["f"], _kinds(x["f"], "$REPLACE", "$APPEND").alias("k")), build),
    )


def keep_all_record(tokens: Column) -> Column:
    return F.struct(
        tokens.alias("tokens"), F.array_repeat(F.lit(rules.KEEP), F.size(tokens)).alias("action_tags")
    )


def delete_runs(ops_first: Column) -> Column:
    """Runs of deleted tokens: ``array<struct<lo, hi>>``."""
    return bind(
        ops_first,
        lambda f: F.filter(
            run_bounds(f, lambda a, b: (a == rules.DELETE) & (b == rules.DELETE)),
            lambda r: F.get(f, r["lo"]) == rules.DELETE,
        ),
    )


# ---- model rows ----------------------------------------------------------------


@bound(2)
def align_labels(word_ids: Column, label_ids: Column, b_to_i: Column | None = None) -> Column:
    """Label per sub-token: special pieces (null word) -100, the first piece of a
    word its label, later pieces -100 or, given ``b_to_i``, the mapped label."""

    def one(w: Column, i: Column) -> Column:
        lab = F.get(label_ids, w)
        later = F.lit(rules.IGNORE) if b_to_i is None else F.get(b_to_i, lab)
        return (
            F.when(w.isNull(), F.lit(rules.IGNORE))
            .when(F.get(word_ids, i - 1).eqNullSafe(w), later)
            .otherwise(lab)
        )

    return F.transform(word_ids, one)


@bound(3)
def align_slots(piece_ids: Column, word_ids: Column, word_mask: Column, mask_id: int, pad_id: int, slot: int = 4) -> Column:
    """``array<struct<input_id, label, type_id, attention>>`` with fixed-size slots.

    A run of pieces whose words have mask 1 becomes one slot: the first
    ``slot`` pieces masked with their ids as labels, shorter runs filled up
    with the pad id as label; all other pieces keep their id, label -100.
    """

    def cell(input_id: Column, label: Column) -> Column:
        return F.struct(
            input_id.cast("int").alias("input_id"),
            label.cast("int").alias("label"),
            F.lit(0).alias("type_id"),
            F.lit(1).alias("attention"),
        )

    flags = F.transform(word_ids, lambda w: F.coalesce(F.get(word_mask, w), F.lit(0)))

    def from_flags(f: Column) -> Column:
        def run(r: Column) -> Column:
            ids = F.slice(piece_ids, r["lo"] + 1, r["hi"] - r["lo"] + 1)
            filled = F.concat(
                F.transform(F.slice(ids, 1, slot), lambda p: cell(F.lit(mask_id), p)),
                F.array_repeat(
                    cell(F.lit(mask_id), F.lit(pad_id)), F.greatest(F.lit(slot) - F.size(ids), F.lit(0))
                ),
            )
            kept = F.transform(ids, lambda p: cell(p, F.lit(rules.IGNORE)))
            return F.when(F.get(f, r["lo"]) == 1, filled).otherwise(kept)

        return F.flatten(F.transform(run_bounds(f, lambda a, b: a == b), run))

    return bind(flags, from_flags)


def pad_to(a: Column, length: Column, pad: Column, left: bool = False) -> Column:
    """Cut or fill an array to exactly ``length`` items."""
    fill = F.array_repeat(pad, F.greatest(length - F.size(a), F.lit(0)))
    cut = F.slice(a, F.lit(1), length)
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def round_up(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def pad_batches(rows: DataFrame, array: str, batch: str, pad: int, multiple: int = 1, left: bool = False) -> DataFrame:
    """Pad every row to its batch's longest, rounded up (batches are small)."""
    longest = F.max(F.size(array)).over(Window.partitionBy(batch))
    return rows.withColumn("_len", round_up(longest, multiple)).withColumn(
        array, pad_to(F.col(array), F.col("_len"), F.lit(pad), left)
    ).drop("_len")


def slot_masking(input_ids: Column, flags: Column, mask_id: int, pad_id: int, mlm: bool = True) -> Column:
    """Collated cells from ids and flags (1 slot, 0 plain, -1 pad)."""

    def one(t: Column, m: Column) -> Column:
        is_slot = m == 1
        if mlm:
            new_id = F.when(is_slot, F.lit(mask_id)).otherwise(t)
            label = F.when(is_slot, t).otherwise(F.lit(rules.IGNORE))
        else:
            new_id = t
            label = F.when(t == pad_id, F.lit(rules.IGNORE)).otherwise(t)
        return F.struct(
            new_id.cast("int").alias("input_id"),
            label.cast("int").alias("label"),
            F.when(m == -1, 0).otherwise(1).alias("attention"),
        )

    return F.zip_with(input_ids, flags, one)


def random_masking(
    ids: Column, key: Column, special: Column, mask_id: int, vocab: int, p: float = 0.15, seed: int = 0
) -> Column:
    """Reproducible token masking: of the picked tokens 80 % become the mask, 10 %
    a random id, 10 % stay; labels are -100 elsewhere. ``special`` ids never."""

    def draw(i: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64(key, i, F.lit(seed + salt)), F.lit(1_000_000)) / 1e6

    def one(t: Column, i: Column) -> Column:
        picked = (draw(i, 1) < p) & ~F.array_contains(special, t)
        how = draw(i, 2)
        noise = F.pmod(F.xxhash64(key, i, F.lit(seed + 3)), F.lit(vocab)).cast("int")
        return F.struct(
            F.when(picked & (how < 0.8), F.lit(mask_id))
            .when(picked & (how < 0.9), noise)
            .otherwise(t)
            .alias("input_id"),
            F.when(picked, t).otherwise(F.lit(rules.IGNORE)).alias("label"),
        )

    return F.transform(ids, one)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    def shifted(x: Column) -> Column:
        return F.transform(x, lambda v: F.exp((v - F.array_max(x)) / F.lit(float(temperature))))

    return bind(
        bind(logits, shifted),
        lambda e: bind(
            F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v), lambda s: F.transform(e, lambda v: v / s)
        ),
    )


def confidence_fallback(logits: Column, keep_id: int, min_prob: float) -> Column:
    """Predicted id, or ``keep_id`` where another id's probability is too low."""
    return bind(
        softmax(logits),
        lambda p: bind(
            F.struct(argmax(p).cast("int").alias("k"), F.array_max(p).alias("p")),
            lambda x: F.when((x["k"] != keep_id) & (x["p"] < min_prob), F.lit(keep_id)).otherwise(x["k"]),
        ),
    )


@bound(2)
def fill_slots(tokens: Column, predictions: Column) -> Column:
    """Drop bracketed spans; the k-th remaining mask takes the k-th prediction.

    Raises if the number of masks and predictions differ.
    """
    opens = [rules.DELETE_OPEN, rules.VERB_OPEN]
    closes = [rules.DELETE_CLOSE, rules.VERB_CLOSE]

    def outside(t: Column) -> Column:
        marks = F.filter(index_range(F.size(t)), lambda i: F.get(t, i).isin(opens + closes))

        def spans(m: Column) -> Column:
            # pieces between neighbouring marks; a piece after an opening mark is inside
            whole = F.concat(F.array(F.lit(-1)), m)
            return bind(
                whole,
                lambda w: F.flatten(
                    F.transform(
                        w,
                        lambda lo, k: F.when(
                            (lo >= 0) & F.get(t, F.greatest(lo, F.lit(0))).isin(opens),
                            F.array().cast("array<string>"),
                        ).otherwise(
                            F.slice(t, lo + 2, F.coalesce(F.get(w, k + 1), F.size(t)) - lo - 1)
                        ),
                    )
                ),
            )

        return bind(marks, spans)

    def fill(t: Column) -> Column:
        at = F.filter(index_range(F.size(t)), lambda i: F.get(t, i) == rules.MASK)

        def done(a: Column) -> Column:
            pieces = F.transform(
                index_range(F.size(a)),
                lambda k: F.concat(
                    F.slice(
                        t,
                        F.when(k == 0, F.lit(1)).otherwise(F.get(a, k - 1) + 2),
                        F.get(a, k) - F.when(k == 0, F.lit(0)).otherwise(F.get(a, k - 1) + 1),
                    ),
                    F.array(F.get(predictions, k)),
                ),
            )
            last = F.coalesce(F.get(a, F.size(a) - 1), F.lit(-1))
            tail = F.slice(t, last + 2, F.size(t))
            return F.when(
                F.size(a) == F.size(predictions), F.concat(F.flatten(pieces), tail)
            ).otherwise(
                F.raise_error(F.lit("masks and predictions differ in number")).cast("array<string>")
            )

        return bind(at, done)

    return bind(bind(tokens, outside), fill)


@bound(3)
def strip_ignored(pred: Column, gold: Column, id2label: Column) -> Column:
    """``struct<pred, gold>`` of ``B-label`` names where gold is not -100."""
    kept = F.filter(F.arrays_zip(pred.alias("p"), gold.alias("g")), lambda x: x["g"] != rules.IGNORE)

    def named(side: str) -> Column:
        return F.transform(kept, lambda x: F.concat(F.lit("B-"), F.get(id2label, x[side])))

    return F.struct(named("p").alias("pred"), named("g").alias("gold"))
