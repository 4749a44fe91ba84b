"""Incremental ingest and stateful pairing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Work off everything available now into a parquet sink, then stop.

    The checkpoint remembers finished files, so a later run takes new ones only.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def incremental_ingest(
    spark: SparkSession,
    folder: str,
    schema: str,
    sink: str,
    checkpoint: str,
    files_per_trigger: int = 100,
    step: Callable[[DataFrame], DataFrame] = lambda df: df,
    fmt: str = "parquet",
) -> DataFrame:
    """Every file of a folder exactly once through ``step`` into ``sink``."""
    stream = (
        spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    )
    drain(step(stream), sink, checkpoint)
    return spark.read.parquet(sink)


def stream_pairs(kept: DataFrame, horizon: str | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Parent pairing on a stream of kept revisions, in whatever order they come.

    A stream-stream join on the revision id (and on the columns ``within``, the
    page, where ids are unique inside those only): state is spread by id, not
    by page, so one page with a third of all revisions is no hot spot. With a
    ``horizon`` (for example ``"90 days"``) a watermark on ``timestamp`` drops
    parents older than that from the state; without one nothing is dropped.
    """
    child = kept.select("page_id", "rev_id", "parent_id", *(["timestamp"] if horizon else []))
    inside = [F.col(c).alias(f"_in_{c}") for c in within]
    parent = kept.select(F.col("rev_id").alias("_pid"), *inside, *([F.col("timestamp").alias("_pts")] if horizon else []))
    on = F.col("parent_id") == F.col("_pid")
    for c in within:
        on = on & (F.col(c) == F.col(f"_in_{c}"))
    if horizon:
        child = child.withWatermark("timestamp", horizon)
        parent = parent.withWatermark("_pts", horizon)
        on = (
            on
            & (F.col("_pts") <= F.col("timestamp"))
            & (F.col("timestamp") <= F.col("_pts") + F.expr(f"INTERVAL {horizon}"))
        )
    return child.join(parent, on).select("page_id", "rev_id", "parent_id")
