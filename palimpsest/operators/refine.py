"""Refinement of edit pairs: rewriting and the chain of accept / reject filters.

An edit pair has ``comment, src, tgt``. Predicates are Columns that are true
for rows to keep, so any of them serves ``filter``, ``split_rows`` and
``reject_report`` alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules, sequence, text as tx
from ..functions.collections import bind, bound
from ..functions.bleu import MAX_ORDER, any_above, bleu, lengths_allow
from .ordering import halo_blocks, with_index


def length_ok(
    src: Column,
    tgt: Column,
    comment: Column,
    min_len: int = 2,
    max_len: int = 400,
    min_words: int = 3,
    max_diff: int = -1,
    min_short: int = -1,
) -> Column:
    a, b = F.char_length(src), F.char_length(tgt)
    keep = a.between(min_len, max_len) & b.between(min_len, max_len) & (F.size(tx.words(comment)) >= min_words)
    if max_diff != -1:
        keep = keep & (F.abs(a - b) <= max_diff)
    if min_short != -1:
        keep = keep & (a - b >= min_short)
    return keep


def bleu_ok(src: Column, tgt: Column, low: float = -100, high: float = 100) -> Column:
    return bind(bleu(tx.tokenize(tgt), tx.tokenize(src)), lambda score: (score > low) & (score < high))


def refine_pairs(
    pairs: DataFrame,
    check_comment: bool = True,
    check_markup: bool = True,
    check_length: bool = True,
    check_bleu: bool = True,
    min_bleu: float = -100,
    max_bleu: float = 100,
    **lengths: int,
) -> DataFrame:
    """The whole filter chain, cheap tests first, all native."""
    c, s, t = F.col("comment"), F.col("src"), F.col("tgt")
    out = pairs
    if check_comment:
        out = out.filter(~tx.comment_blacklisted(c)).withColumn("comment", tx.rewrite_comment(c))
    if check_markup:
        out = (
            out.filter(~tx.has_url(s) & ~tx.has_url(t))
            .withColumn("src", tx.modify_markup(s))
            .withColumn("tgt", tx.modify_markup(t))
        )
    if check_length:
        out = out.filter(length_ok(s, t, c, **lengths))
    if check_bleu and (min_bleu >= 0 or max_bleu <= 1):
        out = out.filter(bleu_ok(s, t, min_bleu, max_bleu))
    return out


def split_rows(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Kept rows and rejected rows (a null verdict rejects)."""
    verdict = F.coalesce(keep, F.lit(False))
    return df.filter(verdict), df.filter(~verdict)


def reject_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows per first failed check, in the order given; ``kept`` for the rest."""
    reason = F.lit("kept")
    for name, keep in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(keep, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def overlap_flags(
    pairs: DataFrame,
    order: list[str],
    before: int = 3,
    after: int = 2,
    comment_min: float = 0.9,
    source_min: float = 0.8,
) -> DataFrame:
    """Adds ``overlap``: some neighbour in the frame has nearly the same comment
    *and* source (digits aside). The neighbour is the reference side.

    Both members of such a pair are flagged. Rows sit in blocks that overlap by
    the frame, so the scan order may cross any number of tasks.
    """
    least = {"comment": comment_min, "src": source_min}

    def words(c: str) -> Column:
        def measured(t: Column) -> Column:
            return F.struct(F.size(t).alias("n"), F.array_join(t, " ").alias("t"))

        return bind(tx.tokenize(F.regexp_replace(c, r"[0-9]+", "")), measured)

    indexed = with_index(pairs, order, "_idx")
    # Comparing costs far more than moving the texts suggests, so the number of
    # tasks is set, not merged.
    tasks = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = halo_blocks(indexed, "_idx", before, after, block=64).repartition(tasks, "_block")
    w = Window.partitionBy("_block").orderBy("_idx")
    shifts = [-k for k in range(1, before + 1)] + list(range(1, after + 1))
    measured = placed.withColumn("_t", F.struct(*[words(c).alias(c) for c in least]))
    near = measured.select("*", F.filter(F.array(*[F.lag("_t", -k).over(w) for k in shifts]), lambda x: x.isNotNull()).alias("_n"))
    own = F.col("_t")

    def close(other: Column) -> Column:
        allowed = [lengths_allow(other[c]["n"], own[c]["n"], score) for c, score in least.items()]
        return F.coalesce(reduce(lambda a, b: a & b, allowed), F.lit(False))

    def same(other: Column) -> Column:  # equal texts with words of all orders score 1
        return reduce(lambda a, b: a & b, [(other[c]["n"] >= MAX_ORDER) & (other[c]["t"] == own[c]["t"]) & (x < 1) for c, x in least.items()])

    # a few numbers rule out most neighbours, equal ones settle the row
    left = near.filter("_own").withColumn("_n", F.filter("_n", close)).withColumn("_same", F.exists("_n", same))
    rest = F.when(F.col("_same"), F.slice("_n", 1, 0)).otherwise(F.col("_n"))
    left = left.withColumn("_n", rest)
    texts = [x for c in least for x in (F.when(F.size("_n") > 0, own[c]["t"]), F.transform("_n", lambda x: x[c]["t"]))]  # noqa: B023
    alike = any_above(list(least.values()))(*texts)
    return left.withColumn("_alike", alike).select(*pairs.columns, (F.col("_same") | F.col("_alike")).alias("overlap"))


def with_meaningless_flag(pairs: DataFrame) -> DataFrame:
    """Adds ``meaningless``: the removed source characters are digits and dots only."""

    @bound(2)
    def removed(src: Column, ops: Column) -> Column:
        spans = F.filter(ops, lambda o: o["tag"].isin("delete", "replace"))
        return F.array_join(F.transform(spans, lambda o: F.substring(src, o["i1"] + 1, o["i2"] - o["i1"])), "")

    return (
        pairs.withColumn("_ops", sequence.diff_chars("src", "tgt"))
        .withColumn("_gone", removed(F.col("src"), F.col("_ops")))
        .withColumn(
            "meaningless",
            (F.col("_gone") != "") & (tx.strip(F.regexp_replace("_gone", r"[0-9.]+", "")) == ""),
        )
        .drop("_ops", "_gone")
    )


def with_month_flag(pairs: DataFrame) -> DataFrame:
    """Adds ``month_edit``: the replaced source tokens name a month."""

    @bound(2)
    def replaced(tokens: Column, ops: Column) -> Column:
        spans = F.filter(ops, lambda o: o["tag"] == "replace")
        return F.array_join(
            F.flatten(F.transform(spans, lambda o: F.slice(tokens, o["i1"] + 1, o["i2"] - o["i1"]))), ""
        )

    gone = replaced(F.col("_a"), F.col("_ops"))
    return (
        pairs.withColumn("_a", tx.tokenize(F.col("src")))
        .withColumn("_ops", sequence.diff_ops("_a", tx.tokenize(F.col("tgt"))))
        .withColumn("month_edit", tx.contains_any(gone, rules.MONTHS))
        .drop("_ops", "_a")
    )


def select_cluster(pairs: DataFrame, cluster: int) -> DataFrame:
    return pairs.filter(F.col("cluster") == cluster)


def cluster_input(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("revision_id").alias("id"), F.col("comment").alias("text"))


def unchanged_enough(n_sents: Column, n_changed: Column, least: int = 10) -> Column:
    return n_sents - n_changed >= least


def hash_order(key: Column, seed: int = 0) -> Column:
    """Shuffle key that a retried task reproduces."""
    return F.xxhash64(key, F.lit(seed))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows, chosen by the hash of their unique key.

    Only keys are ranked (each task keeps its best ``n``); whole rows stay put.
    """
    picked = df.select(key).orderBy(hash_order(F.col(key), seed), F.col(key)).limit(n)
    return df.join(picked, key, "left_semi")


def split_train_valid(
    df: DataFrame, key: Column, valid: float = 0.1, seed: int = 0, leaky: bool = False
) -> DataFrame:
    """Adds ``split``. ``leaky`` repeats validation rows in the train split."""
    picked = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(valid * 1_000_000)
    if leaky:
        both = F.when(picked, F.array(F.lit("train"), F.lit("valid"))).otherwise(F.array(F.lit("train")))
        return df.withColumn("split", F.explode(both))
    return df.withColumn("split", F.when(picked, "valid").otherwise("train"))
