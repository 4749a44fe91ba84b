"""Edit-tag algebra as native expressions: detect, apply and merge transforms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules
from .collections import bind, bound, index_range


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower (not ``initcap``: one word only)."""
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 1 << 30)))


def _tail(c: Column) -> Column:
    return F.substring(c, 2, 1 << 30)


def _butlast(c: Column) -> Column:
    return F.left(c, F.length(c) - 1)


def case_tag(s: Column, t: Column) -> Column:
    """Which case change turns ``s`` into ``t``; null if none does."""
    hit = (
        F.when(F.lower(s) == t, rules.CASE_LOWER)
        .when(capitalize(s) == t, rules.CASE_CAPITAL)
        .when(F.upper(s) == t, rules.CASE_UPPER)
        .when(
            (capitalize(_tail(s)) == _tail(t)) & (F.left(s, F.lit(1)) == F.left(t, F.lit(1))),
            rules.CASE_CAPITAL_1,
        )
        .when(
            (F.upper(_butlast(s)) == _butlast(t)) & (F.right(s, F.lit(1)) == F.right(t, F.lit(1))),
            rules.CASE_UPPER_1,
        )
    )
    return F.when(F.lower(s) == F.lower(t), hit)


def equal_tag(s: Column, t: Column) -> Column:
    return F.when(s == t, F.lit(rules.KEEP))


def split_tag(s: Column, targets: Column) -> Column:
    return F.when((F.size(targets) > 1) & (F.split(s, "-") == targets), F.lit(rules.SPLIT_HYPHEN))


def plural_tag(s: Column, t: Column) -> Column:
    return F.when(s == F.concat(t, F.lit("s")), F.lit(rules.SINGULAR)).when(
        t == F.concat(s, F.lit("s")), F.lit(rules.PLURAL)
    )


def verb_tag(s: Column, t: Column, known: Column) -> Column:
    """``known``: whether the verb lexicon holds the pair (s, t)."""
    return F.when(known, F.concat(F.lit(rules.VERB), t))


def word_tag(s: Column, t: Column, known_verb: Column | None = None) -> Column:
    """First matching transform of one token into one word; null if none."""
    steps = [equal_tag(s, t), case_tag(s, t)]
    if known_verb is not None:
        steps.append(verb_tag(s, t, known_verb))
    return F.coalesce(*steps, plural_tag(s, t))


def merge_tag(source: Column, targets: Column) -> Column:
    joined = F.array_join(source, "-") == F.get(targets, F.lit(0))
    return F.when(
        (F.size(source) > 1) & (F.size(targets) == 1) & joined, F.lit(rules.MERGE_HYPHEN)
    )


def apply_tag(token: Column, tag: Column) -> Column:
    """What a transform tag makes of a token, as an array of words.

    A tag that is no transform leaves the token; an unknown transform raises.
    A verb tag carries its target after the dash.
    """

    def one(c: Column) -> Column:
        return F.array(c)

    return (
        F.when(~F.startswith(tag, F.lit("$TRANSFORM")), one(token))
        .when(tag == rules.CASE_LOWER, one(F.lower(token)))
        .when(tag == rules.CASE_UPPER, one(F.upper(token)))
        .when(tag == rules.CASE_CAPITAL, one(capitalize(token)))
        .when(tag == rules.CASE_CAPITAL_1, one(F.concat(F.left(token, F.lit(1)), capitalize(_tail(token)))))
        .when(tag == rules.CASE_UPPER_1, one(F.concat(F.upper(_butlast(token)), F.right(token, F.lit(1)))))
        .when(F.startswith(tag, F.lit(rules.VERB)), one(F.substring(tag, len(rules.VERB) + 1, 1 << 30)))
        .when(tag == rules.SPLIT_HYPHEN, F.split(token, "-"))
        .when(tag == rules.PLURAL, one(F.concat(token, F.lit("s"))))
        .when(tag == rules.SINGULAR, one(_butlast(token)))
        .otherwise(one(F.raise_error(F.concat(F.lit("unknown transform "), tag)).cast("string")))
    )


@bound(1)
def realise_merges(tokens: Column) -> Column:
    """Turn merge markers between tokens into a hyphen or nothing."""
    line = F.array_join(tokens, " ")
    for marker, glue in [(rules.MERGE_HYPHEN, "-"), (rules.MERGE_SPACE, "")]:
        line = F.replace(line, F.lit(f" {marker} "), F.lit(glue))
    has_marker = F.exists(tokens, lambda t: F.startswith(t, F.lit("$MERGE_")))
    return F.when(has_marker, F.filter(F.split(line, r"\s+"), lambda x: x != "")).otherwise(tokens)


@bound(2)
def apply_edits(tokens: Column, labels: Column) -> Column:
    """Tokens after applying per-position op lists.

    ``labels`` has one list more than ``tokens``: the first belongs to the
    start position, which only takes appended words. Each position turns into
    an ordered fragment, so no positions shift.
    """

    def fragment(ops: Column, i: Column) -> Column:
        def step(acc: Column, op: Column) -> Column:
            appended = F.startswith(op, F.lit(rules.APPEND))
            return (
                F.when(op == rules.DELETE, F.array().cast("array<string>"))
                .when(appended, F.concat(acc, F.array(F.substring(op, len(rules.APPEND) + 1, 1 << 30))))
                .when(
                    F.startswith(op, F.lit(rules.REPLACE)),
                    F.array(F.substring(op, len(rules.REPLACE) + 1, 1 << 30)),
                )
                .when(
                    F.startswith(op, F.lit("$TRANSFORM")),
                    F.array(F.array_join(apply_tag(F.get(tokens, i - 1), op), " ")),
                )
                .when(F.startswith(op, F.lit("$MERGE_")), F.concat(acc, F.array(op)))
                .otherwise(acc)
            )

        own = F.when(i == 0, F.array().cast("array<string>")).otherwise(F.array(F.get(tokens, i - 1)))
        return F.aggregate(ops, own, step)

    return realise_merges(F.flatten(F.transform(labels, fragment)))


@bound(2)
def edits_to_labels(edits: Column, n_tokens: Column) -> Column:
    """Dense op lists for positions -1..n-1 from ``(pos, op)`` edits in order.

    The edits must be sorted by position (stable). Runs of equal positions
    become op lists, gaps are filled with KEEP: linear in tokens plus edits.
    """
    from .collections import run_bounds

    keep = F.array(F.array(F.lit(rules.KEEP)))

    def dense(e: Column) -> Column:
        def with_runs(runs: Column) -> Column:
            def piece(r: Column, k: Column) -> Column:
                here = F.get(e, r["lo"])["pos"]
                before = F.when(k == 0, F.lit(-2)).otherwise(F.get(e, F.get(runs, k - 1)["lo"])["pos"])
                ops = F.transform(
                    F.slice(e, r["lo"] + 1, r["hi"] - r["lo"] + 1), lambda x: x["op"]
                )
                return F.concat(
                    F.flatten(F.array_repeat(keep, (here - before - 1).cast("int"))), F.array(ops)
                )

            last = F.coalesce(F.get(e, F.size(e) - 1)["pos"], F.lit(-2))
            return F.concat(
                F.flatten(F.transform(runs, piece)),
                F.flatten(F.array_repeat(keep, (n_tokens - 1 - last).cast("int"))),
            )

        return bind(run_bounds(e, lambda a, b: a["pos"] == b["pos"]), with_runs)

    return bind(edits, dense)


def to_tagged_line(tokens: Column, labels: Column) -> Column:
    """``token SEPL|||SEPR op[SEPL__SEPR op]*`` items, space-joined, start token first."""
    with_start = F.concat(F.array(F.lit(rules.START)), tokens)
    return F.array_join(
        F.zip_with(
            with_start,
            labels,
            lambda t, ops: F.concat(t, F.lit(rules.LABEL_SEP), F.array_join(ops, rules.OP_SEP)),
        ),
        " ",
    )


def parse_tagged_line(line: Column) -> Column:
    """``struct<tokens, ops>`` of a tagged line; the label is what follows the
    last delimiter, and the start token is added if missing."""

    def label(item: Column) -> Column:
        return F.substring_index(item, rules.LABEL_SEP, -1)

    def pack(items: Column) -> Column:
        tokens = F.transform(
            items, lambda x: F.left(x, F.length(x) - F.length(label(x)) - len(rules.LABEL_SEP))
        )
        op_sep = rules.OP_SEP
        ops = F.transform(items, lambda x: F.split(label(x), op_sep))
        missing = F.get(tokens, F.lit(0)) != rules.START
        return F.struct(
            F.when(missing, F.concat(F.array(F.lit(rules.START)), tokens)).otherwise(tokens).alias("tokens"),
            ops.alias("ops"),
        )

    return bind(F.split(line, " "), pack)


def one_tag_per_token(ops: Column) -> Column:
    """First op of each token; appended / replaced words are cut off."""
    return F.transform(
        ops, lambda o: F.regexp_replace(F.get(o, F.lit(0)), r"^(\$APPEND|\$REPLACE)_(?s:.*)$", "$1")
    )


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"Column", "F", "bind", "index_range"}]
