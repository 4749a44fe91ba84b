"""Ordered operators that never put a whole group, or the whole table, in one task.

A plain ``row_number().over(partitionBy(key))`` sends a key that holds a third
of all rows to one task, and an unpartitioned one sends everything there. Here
rows are range-partitioned on *(key, order)*, so a big key spans many tasks,
and only per-partition totals (one row per partition) are combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

_PART_BITS = 33


def _placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Globally sorted rows with a frozen ``(_part, _slot)`` place.

    The place depends on sampled range bounds, so it is written down once
    (reliable checkpoint) before anything is derived from it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_slot", F.monotonically_increasing_id())
    return cut_lineage(ranged).withColumn("_part", F.shiftright("_slot", _PART_BITS))


def _part_offsets(placed: DataFrame) -> DataFrame:
    """Rows before each partition; one row per partition, hence small."""
    per_part = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base")
    )


def with_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Dense 0-based index over the whole table in the given order."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = _placed(df, order)
    row_mask = (1 << _PART_BITS) - 1
    return (
        placed.join(F.broadcast(_part_offsets(placed)), "_part")
        .withColumn(name, F.col("_base") + F.col("_slot").bitwiseAND(F.lit(row_mask)))
        .drop("_part", "_slot", "_base")
    )


def group_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank"
) -> DataFrame:
    """0-based ``row_number`` per group, exact for groups of any size.

    Rows are numbered inside *(partition, group)*. A group continues into the
    next partition at most once per partition border, so the table of
    carried-over counts has at most two rows per partition and is broadcast.
    """
    placed = _placed(df, [F.col(c) for c in (*group, *order)])
    keys = [F.col(c) for c in group]
    packed = F.struct(*keys)
    pieces = placed.groupBy("_part", packed.alias("_g")).agg(F.count("*").alias("_rows"))
    edges = placed.groupBy("_part").agg(
        F.min_by(packed, "_slot").alias("_first"), F.max_by(packed, "_slot").alias("_last")
    )
    edge_groups = edges.select(
        "_part", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_g")
    )
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        pieces.join(F.broadcast(edge_groups), ["_part", "_g"])
        .withColumn("_carry", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .filter("_carry > 0")
        .select("_part", "_g", "_carry")
    )
    inside = Window.partitionBy("_part", *group).orderBy("_slot")
    numbered = placed.withColumn(name, F.row_number().over(inside) - 1).withColumn("_g", packed)
    return (
        numbered.join(F.broadcast(carried), ["_part", "_g"], "left")
        .withColumn(name, (F.col(name) + F.coalesce("_carry", F.lit(0))).cast("bigint"))
        .drop("_part", "_slot", "_g", "_carry")
    )


def halo_blocks(df: DataFrame, idx: str, before: int, after: int, block: int = 2048) -> DataFrame:
    """Cut a densely indexed table into blocks that carry their neighbours' edges.

    Adds ``_block`` (window partition key) and ``_own`` (false on the copied
    edge rows). A ROWS frame of up to ``before`` / ``after`` rows over
    ``partitionBy(_block).orderBy(idx)`` is then exact on the owned rows,
    while no window partition exceeds ``block + before + after`` rows.
    """
    if max(before, after) > block:
        raise ValueError("the frame must fit in one block")
    home = F.floor(F.col(idx) / F.lit(block)).cast("bigint")
    offset = F.col(idx) % block
    none = F.array().cast("array<bigint>")
    homes = F.concat(
        F.array(home),
        F.when(offset >= block - before, F.array(home + 1)).otherwise(none),
        F.when((offset < after) & (home > 0), F.array(home - 1)).otherwise(none),
    )
    return df.withColumn("_block", F.explode(homes)).withColumn("_own", F.col("_block") == home)


def previous_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], carry: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """``lag`` inside each group without giving a group to one task."""
    indexed = with_index(df, [*group, *order], "_idx")
    blocks = halo_blocks(indexed, "_idx", 1, 0)
    w = Window.partitionBy("_block").orderBy("_idx")
    same = F.lit(True)
    for c in group:
        same = same & F.lag(F.col(c)).over(w).eqNullSafe(F.col(c))
    has_prev = F.lag(F.lit(1)).over(w).isNotNull()
    lagged = blocks.select(
        "*",
        (same & has_prev).alias("_same"),
        *[F.lag(F.col(c)).over(w).alias(f"_lag_{c}") for c in carry],
    ).filter("_own")
    return lagged.select(
        *df.columns,
        *[F.when(F.col("_same"), F.col(f"_lag_{c}")).alias(f"{prefix}{c}") for c in carry],
    )
