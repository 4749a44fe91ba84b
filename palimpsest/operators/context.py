"""Context around edits: windows, sentence spans, common-context stripping.

All functions but ``context_records`` are Column expressions over arrays of one
record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.collections import bind, bound, index_range, prefix_sums


@bound(3)
def sentence_of_token(sents: Column, tokens: Column, token_diff: Column) -> Column:
    """Indices of the sentences holding a changed token longer than one character.

    Sentence starts and changed positions are sorted together: a sentence is hit
    if a position follows its start before the next start does.
    """

    def places(p: Column) -> Column:
        starts = F.transform(p, lambda at, i: F.struct(at.alias("at"), i.alias("sentence"), F.lit(False).alias("hit")))
        long = F.filter(token_diff, lambda d: F.char_length(F.get(tokens, d)) > 1)
        none = F.lit(2_147_483_647)  # behind all starts at the same place
        return F.sort_array(F.concat(starts, F.transform(long, lambda d: F.struct(d.cast("int").alias("at"), none.alias("sentence"), F.lit(True).alias("hit")))))

    def hit(s: Column) -> Column:
        at = F.filter(
            index_range(F.size(s)),
            lambda k: ~F.get(s, k)["hit"] & F.coalesce(F.get(s, k + 1)["hit"], F.lit(False)) & (F.get(s, k)["sentence"] < F.size(sents)),
        )
        return F.transform(at, lambda k: F.get(s, k)["sentence"])

    return bind(bind(prefix_sums(F.transform(sents, lambda s: F.size(s))), places), hit)


@bound(2)
def context_window(tokens: Column, diff: Column, width: int) -> Column:
    """Tokens within ``width`` of a changed position, flagged 1 = changed, 0 = context.

    Each changed position lists its neighbours; sorted, the last entry of a
    position tells whether it changed. Work grows with positions times the window.
    """
    near = F.flatten(
        F.transform(
            diff,
            lambda d: F.transform(
                F.filter(F.sequence(d - width, d + width), lambda i: (i >= 0) & (i < F.size(tokens))),
                lambda i: F.struct(i.alias("pos"), (i == d).cast("int").alias("action")),
            ),
        )
    )

    def last(s: Column) -> Column:
        ends = F.filter(s, lambda x, k: ~F.coalesce(F.get(s, k + 1)["pos"] == x["pos"], F.lit(False)))
        return F.transform(ends, lambda x: F.struct(x["pos"].alias("pos"), F.get(tokens, x["pos"]).alias("token"), x["action"].alias("action")))

    return bind(F.sort_array(near), last)


@bound(3)
def extend_sentences(
    sents: Column, start: Column, end: Column, max_tokens: int = 200, max_add: int = 2
) -> Column:
    """Grow the span [start, end] by a sentence at each end per round while it
    holds at most ``max_tokens`` tokens, is not everything and neither side got
    ``max_add``. Returns ``struct<start, end, offset>`` (token offset of start)."""
    sizes = F.transform(sents, lambda s: F.size(s))

    def grow(p: Column) -> Column:
        def total(x: Column) -> Column:
            return F.get(p, x["e"] + 1) - F.get(p, x["s"])

        last = F.size(p) - 2

        def step(x: Column, _: Column) -> Column:
            go = (
                (total(x) <= max_tokens)
                & (x["e"] - x["s"] < last)
                & (start - x["s"] < max_add)
                & (x["e"] - end < max_add)
            )
            return F.struct(
                F.when(go & (x["s"] > 0), x["s"] - 1).otherwise(x["s"]).alias("s"),
                F.when(go & (x["e"] < last), x["e"] + 1).otherwise(x["e"]).alias("e"),
            )

        grown = F.aggregate(
            F.sequence(F.lit(1), F.lit(max_add)),
            F.struct(start.cast("int").alias("s"), end.cast("int").alias("e")),
            step,
        )
        return bind(
            grown,
            lambda x: F.struct(
                x["s"].alias("start"), x["e"].alias("end"), F.get(p, x["s"]).alias("offset")
            ),
        )

    return bind(prefix_sums(sizes), grow)


@bound(3)
def map_context(sents: Column, start_sent: Column, end_sent: Column) -> Column:
    """First sentence containing the start sentence through the first containing
    the end sentence (as joined text): ``struct<start, end, offset>`` or null."""

    def first_with(lines: Column, sent: Column) -> Column:
        hits = F.transform(lines, lambda s: F.contains(s, sent))
        return (F.array_position(hits, True) - 1).cast("int")

    def locate(x: Column) -> Column:
        span = F.struct(
            first_with(x["lines"], x["first"]).alias("s"), first_with(x["lines"], x["last"]).alias("e")
        )
        return bind(
            span,
            lambda y: F.when(
                (y["s"] >= 0) & (y["e"] >= y["s"]),
                F.struct(
                    y["s"].alias("start"),
                    y["e"].alias("end"),
                    F.aggregate(
                        F.slice(sents, F.lit(1), y["s"]), F.lit(0), lambda acc, s: acc + F.size(s)
                    ).alias("offset"),
                ),
            ),
        )

    return bind(
        F.struct(
            F.transform(sents, lambda s: F.array_join(s, " ")).alias("lines"),
            F.array_join(start_sent, " ").alias("first"),
            F.array_join(end_sent, " ").alias("last"),
        ),
        locate,
    )


@bound(2)
def strip_common_context(a: Column, b: Column, max_tokens: int = 200) -> Column:
    """Drop equal sentences in rounds (one at the front, one at the back) while
    either side has more than ``max_tokens`` tokens; an end stops at its first
    mismatch, and the rounds stop when a side is used up.

    Returns ``struct<fits, front, back, offset>``: whether both sides now fit,
    sentences cut at each end, and tokens cut at the front. Cuts are bounded by
    the common prefix and suffix, so the round is found among prefix sums.
    """
    n = F.least(F.size(a), F.size(b))

    def common(back: bool) -> Column:
        def differs(k: Column) -> Column:
            if back:
                return F.get(a, F.size(a) - 1 - k) != F.get(b, F.size(b) - 1 - k)
            return F.get(a, k) != F.get(b, k)

        first = F.filter(index_range(n), differs)
        return F.coalesce(F.get(first, F.lit(0)), n)

    def solve(x: Column) -> Column:
        size_a, size_b = F.size(a), F.size(b)

        def state(rounds: Column) -> Column:
            f = F.least(rounds, x["f"])
            k = F.least(rounds, x["b"], n - f)
            left_a = F.get(x["pa"], size_a - k) - F.get(x["pa"], f)
            left_b = F.get(x["pb"], size_b - k) - F.get(x["pb"], f)
            return F.struct(
                ((left_a <= max_tokens) & (left_b <= max_tokens)).alias("fits"),
                f.alias("front"),
                k.alias("back"),
                F.get(x["pa"], f).alias("offset"),
            )

        states = F.transform(F.sequence(F.lit(0), F.greatest(x["f"], x["b"])), state)
        return bind(
            states,
            lambda s: F.coalesce(
                F.get(F.filter(s, lambda y: y["fits"] | (y["front"] + y["back"] == n)), F.lit(0)),
                F.element_at(s, -1),
            ),
        )

    return bind(
        F.struct(
            common(False).alias("f"),
            common(True).alias("b"),
            prefix_sums(F.transform(a, lambda s: F.size(s))).alias("pa"),
            prefix_sums(F.transform(b, lambda s: F.size(s))).alias("pb"),
        ),
        solve,
    )


def shift_diff(diff: Column, offset: Column, drop_leading: bool = False) -> Column:
    """Diff positions relative to a cut context; optionally without a leading -1."""
    moved = F.transform(diff, lambda d: d - offset)
    if not drop_leading:
        return moved
    return bind(
        moved,
        lambda m: F.when(F.get(m, F.lit(0)) == -1, F.slice(m, F.lit(2), F.size(m))).otherwise(m),
    )


def unchanged(n: Column, changed: Column) -> Column:
    return F.array_except(index_range(n), changed)


@bound(3)
def edit_examples(sents: Column, changed: Column, key: Column, k: int = 10, by_hash: bool = False) -> Column:
    """``struct<pos, neg>``: changed sentences and up to ``k`` unchanged ones.

    ``by_hash`` picks the unchanged ones in a reproducible shuffled order,
    otherwise the first ``k`` are taken.
    """
    rest = unchanged(F.size(sents), changed)
    if by_hash:
        mixed = F.array_sort(F.transform(rest, lambda i: F.struct(F.xxhash64(key, i).alias("h"), i.alias("i"))))
        rest = F.transform(mixed, lambda x: x["i"])
    return F.struct(
        F.transform(changed, lambda i: F.get(sents, i)).alias("pos"),
        F.transform(F.slice(rest, 1, k), lambda i: F.get(sents, i)).alias("neg"),
    )


def bottom_k(indices: Column, key: Column, k: int, seed: int = 0) -> Column:
    """``k`` of some indices, in order: those whose hash with seed and key is
    smallest. The same choice on every run and in every partitioning."""
    hashed = F.transform(indices, lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("h"), i.alias("i")))
    return F.sort_array(F.transform(F.slice(F.array_sort(hashed), 1, k), lambda x: x["i"]))


def context_records(pairs: DataFrame, negatives: DataFrame, window: int = 2, k: int = 10, seed: int = 0) -> DataFrame:
    """One training record per revision pair with a change.

    ``pairs``: ``page_id, rev_id, parent_id, comment``, and per side (``src``,
    ``tgt``) ``_sents`` (sentences), ``_tokens`` (their tokens) and ``_diff`` (changed
    positions over all tokens). ``negatives``: ``page_id, rev_id, negatives`` (other
    comments of the page), joined by revision; it has one row per commented revision.

    Out: ``page_id, rev_id, parent_id, comment`` (tokens), per side ``_token`` and
    ``_action`` (the tokens within ``window`` of a change; 1 = changed), ``pos_edits``
    (changed target sentences), ``neg_edits`` (up to ``k`` others, a seeded sample)
    and ``neg_comments`` (tokens each; none where the page has no other comment).
    """
    flat = pairs.withColumns({f"{side}_flat": F.flatten(f"{side}_tokens") for side in ("src", "tgt")})
    changed = flat.filter((F.size("src_diff") > 0) | (F.size("tgt_diff") > 0))
    windows = {f"{side}_window": context_window(F.col(f"{side}_flat"), F.col(f"{side}_diff"), window) for side in ("src", "tgt")}
    hit = sentence_of_token(F.col("tgt_tokens"), F.col("tgt_flat"), F.col("tgt_diff"))
    marked = changed.withColumns({**windows, "hit": hit})
    rest = bottom_k(unchanged(F.size("tgt_sents"), F.col("hit")), F.col("rev_id"), k, seed)
    of = lambda places: F.transform(places, lambda i: F.get("tgt_sents", i))
    record = marked.select(
        "page_id",
        "rev_id",
        "parent_id",
        tx.tokenize(F.col("comment")).alias("comment"),
        *(F.transform(f"{side}_window", lambda x: x[part]).alias(f"{side}_{part}") for side in ("src", "tgt") for part in ("token", "action")),  # noqa: B023
        of(F.col("hit")).alias("pos_edits"),
        of(rest).alias("neg_edits"),
    )
    other = negatives.select("page_id", "rev_id", F.transform("negatives", lambda c: tx.tokenize(c)).alias("neg_comments"))
    none = F.array().cast("array<array<string>>")
    return record.join(other, ["page_id", "rev_id"], "left").withColumn("neg_comments", F.coalesce("neg_comments", none))
