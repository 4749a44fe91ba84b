"""Shards that each match the mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. A row's
fractional rank ``(2 rank + 1) / (2 rows of its source)`` places it in the
whole: sorted by it, every stretch holds the sources in the table's proportions.
Equal cuts of that order are the shards, so row counts differ by one at most.

Both orders are range-partitioned sorts of narrow rows (no text moves), and a
source with a third of all rows spans many tasks; DataFrame functions only.

Defined results: a null source is a source of its own; null texts have size 1
and the checksum of the empty text; rows that repeat are placed one by one (they
are interchangeable); null ids shuffle as the text ``null``; fewer rows than
shards leave the last shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ordering import group_rank, with_index
from .common import written

SHARDS = 8
SEED = "shard-1"


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        F.col(source_col).isNull().alias("_unnamed"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shuffled.alias("_key"),
    )
    ranked = group_rank(rows, ["_unnamed", "_source"], ["_key", "doc_id", "size", "text_crc32"], "_rank")
    per_source = written(ranked.groupBy("_unnamed", "_source").agg(F.count("*").alias("_n")), "source_rows")
    total = per_source.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]  # one number
    placed = ranked.join(per_source, ["_unnamed", "_source"])
    placed = placed.withColumn("_at", (F.col("_rank") * 2 + 1) / (F.col("_n") * 2))
    indexed = with_index(placed, ["_at", "_unnamed", "_source", "_rank"], "_i")
    shard = F.expr(f"cast(_i * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return indexed.withColumn("_shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_i") - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.when(~F.col("_unnamed"), F.col("_source")).alias("source"),
    )
