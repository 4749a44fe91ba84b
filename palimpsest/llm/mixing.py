"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target and hence a repetition
rate, and a document is emitted ``floor(rate)`` times plus once more with the
rate's fraction as probability. The draw is a hash of seed and document id, so
reruns and retried tasks agree. Each source takes, of ``SEEDS`` seeds, the one
whose draw comes nearest to its target; all of them are summed in one pass. So the
draw is a selected one: under each single seed a document's chance is the fraction,
but the choice favours draws near the target, and in a source of few documents the
chance of one of them can be far from it (a lone document whose fraction is below a
half is hardly ever taken once more). ``SEEDS = 1`` draws without the choice.

Defined results: a null source is a source of its own (last in order); null or
empty texts have size 0; rows that repeat a doc_id share one draw; a null
doc_id draws as the text ``null``; a source without words has target 0 and its
rows are not repeated; an empty table gives an empty mix. Other columns pass
through, whatever their names.

Scale: one aggregate by source with map-side sums, and a join with the table of
sources, which the optimizer broadcasts only if its written size allows;
otherwise the join shuffles and adaptive execution splits a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, quoted, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEEDS = 16
_BITS = 48


def draw(seed, doc_id: Column) -> Column:
    """A number in [0, 2^48) from seed and id."""
    key = F.concat(seed.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, _BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size`` -> with ``target``, one row per source.

    Targets are ``level * weight`` but at most ``cap`` times the source; the
    level makes them add up to ``share`` of all words. Sources by
    ``cap / weight`` fill up first; the level is found at the first source that
    stays below its cap. Sorts one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("_room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    here = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("_room").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    ranked = sizes.withColumn("_weight", pick).withColumn("_cap", F.col("source_size") * F.lit(cap))
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(here)
    filled = ranked.withColumn("_room", F.col("_cap") / F.col("_weight")).withColumn("_level", level)
    open_ = F.min(F.when(F.col("_level") <= F.col("_room"), F.struct("_room", "_level"))).over(every)
    target = F.least(F.col("_cap"), F.coalesce(open_["_level"] * F.col("_weight"), F.col("_cap")))
    return filled.select("source", "source_size", target.alias("target"))


def rates(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Sized documents ``doc_id, source, size`` and the written table of sources
    ``source, source_size, target, rate, seed``."""
    size = word_count(F.col("text")) if size is None else size
    sized = written(docs.select("doc_id", "source", size.alias("size")), "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    targets = source_targets(per_source, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = written(targets.withColumn("rate", rate), "targets")
    drawn = with_source(sized, targets.select("source", "rate"))
    sums = [
        F.sum(F.when(_extra(F.lit(s), F.col("doc_id"), F.col("rate")), F.col("size")).otherwise(0)).cast("bigint").alias(f"s{s}")
        for s in range(SEEDS)
    ]
    totals = drawn.groupBy("source").agg(*sums)
    joined = targets.join(totals.withColumnRenamed("source", "_s"), targets["source"].eqNullSafe(F.col("_s"))).drop("_s")
    wanted = F.col("target") - F.floor("rate") * F.col("source_size")
    misses = F.array(*[F.struct(F.abs(F.col(f"s{s}") - wanted).alias("miss"), F.lit(s).alias("seed")) for s in range(SEEDS)])
    best = joined.select("source", "source_size", "target", "rate", F.array_min(misses)["seed"].alias("seed"))
    return sized, written(best, "rates")


def _extra(seed: Column, doc_id: Column, rate: Column) -> Column:
    return draw(seed, doc_id) < (rate - F.floor(rate)) * F.lit(float(1 << _BITS))


def with_source(docs: DataFrame, sources: DataFrame, source_col: str = "source") -> DataFrame:
    """Join a (small) table of sources to documents; null sources match. Columns
    that both have stay the documents'."""
    new = [c for c in sources.columns if c.lower() not in {d.lower() for d in docs.columns}]
    given, other = docs.alias("given"), sources.alias("other")
    joined = given.join(other, F.col(f"given.{quoted(source_col)}").eqNullSafe(F.col("other.source")))
    return joined.select("given.*", *(F.col(f"other.{quoted(c)}") for c in new))


def copies(docs: DataFrame, sources: DataFrame, name: str = "_copies") -> DataFrame:
    """Adds ``name``: how often the mix takes each document. The row travels as one
    struct beside the source's figures, so that no column of it can clash."""
    row = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col("source"), F.col("doc_id"))
    joined = with_source(row, sources.select("source", "rate", "seed"))
    n = F.floor("rate") + F.when(_extra(F.col("seed"), F.col("doc_id"), F.col("rate")), 1).otherwise(0)
    return joined.select("row.*", n.cast("int").alias(name))


def emit(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The mixed table: every document as often as the mix takes it."""
    name = free_name("_copies", docs)
    counted = copies(docs, sources, name).filter(F.col(name) > 0)
    return counted.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name)))).drop(name)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    _, sources = rates(docs, weights, share, cap)
    return emit(docs, sources)
