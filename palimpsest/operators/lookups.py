"""Joins by key, by position and against a lexicon.

Dimension sides are left to the optimizer's own size-checked broadcast; beyond
its threshold they become shuffled joins with adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules


def add_cluster_by_id(pairs: DataFrame, clusters: DataFrame, version: str | None = None) -> DataFrame:
    """Adds ``cluster`` by id. Of duplicate ids the last (by ``version``) wins; a
    pair without a cluster is an error."""
    if version:
        clusters = clusters.groupBy("id").agg(F.max_by("cluster", version).alias("cluster"))
    joined = pairs.join(clusters.select("id", F.col("cluster").alias("_c")), "id", "left")
    checked = F.when(F.col("_c").isNotNull(), F.col("_c")).otherwise(
        F.raise_error(F.concat(F.lit("no cluster for id "), F.col("id").cast("string"))).cast("int")
    )
    return joined.withColumn("cluster", checked).drop("_c")


def missing_clusters(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    return pairs.join(clusters, "id", "left_anti")


def zip_by_position(left: DataFrame, right: DataFrame, index: str = "line_no") -> DataFrame:
    """Rows of equal position; the shorter side truncates."""
    return left.join(right, index)


def zip_checked(left: DataFrame, right: DataFrame, a: str, b: str, index: str = "line_no") -> DataFrame:
    """Positional join of two array columns that must agree in length."""
    joined = zip_by_position(left, right, index)
    size_ok = F.size(a) == F.size(b)
    return joined.withColumn(
        b,
        F.when(size_ok, F.col(b)).otherwise(
            F.raise_error(F.lit("tokens and tags differ in number")).cast("array<string>")
        ),
    )


def encode_lexicon(lexicon: DataFrame) -> DataFrame:
    """``(w1, w2, t1, t2)`` without later rows of a decode key ``(w1, t1, t2)``."""
    first = F.min_by(F.struct("w2"), "row_no")
    return lexicon.groupBy("w1", "t1", "t2").agg(first.alias("_f")).select("w1", F.col("_f.w2").alias("w2"), "t1", "t2")


def verb_lookup(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``verb_tag``: ``$TRANSFORM_VERB-<target>`` for pairs in the lexicon."""
    known = encode_lexicon(lexicon).select(
        F.col("w1").alias("src"), F.col("w2").alias("tgt")
    ).distinct().withColumn("_hit", F.lit(True))
    return (
        pairs.join(known, ["src", "tgt"], "left")
        .withColumn("verb_tag", F.when(F.col("_hit"), F.concat(F.lit(rules.VERB), F.col("tgt"))))
        .drop("_hit")
    )


def verb_decode(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``word`` for ``(token, t1, t2)``; an unknown key keeps the token."""
    known = encode_lexicon(lexicon).select(F.col("w1").alias("token"), "t1", "t2", F.col("w2").alias("_w"))
    return (
        tokens.join(known, ["token", "t1", "t2"], "left")
        .withColumn("word", F.coalesce("_w", "token"))
        .drop("_w")
    )
