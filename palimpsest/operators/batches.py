"""Batch plans: shards, step counts and the round robin over tasks and heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordering import group_rank, with_index


def steps_per_epoch(task_sizes: DataFrame, batch: int, accumulate: int = 1, epochs: int = 1) -> DataFrame:
    """``batches, updates, total_steps`` from ``task, rows``."""
    batches = F.sum(F.ceil(F.col("rows") / batch)).cast("bigint")
    return task_sizes.agg(batches.alias("batches")).select(
        "batches",
        F.ceil(F.col("batches") / accumulate).cast("bigint").alias("updates"),
        (F.ceil(F.col("batches") / accumulate) * epochs).cast("bigint").alias("total_steps"),
    )


def numbered_batches(rows: DataFrame, group: list[str], order: str, batch: int) -> DataFrame:
    """Adds ``batch_no`` (0-based inside the group)."""
    ranked = group_rank(rows, group, [order], "_rank")
    return ranked.withColumn("batch_no", F.floor(F.col("_rank") / batch).cast("bigint")).drop("_rank")


def round_robin(groups: DataFrame, heads: int, steps: int | None = None) -> DataFrame:
    """Step plan from ``head, task, n_batches``: step s trains head ``s % heads``
    and the next of that head's own tasks in turn; a task that runs out starts
    over. Without ``steps`` the plan has as many steps as all groups have batches;
    heads and tasks alternate evenly, so of an uneven large group it need not reach
    every batch. ``covering_steps`` gives the length that does."""
    if steps is None:
        steps = groups.agg(F.coalesce(F.sum("n_batches"), F.lit(0))).first()[0]
    own = Window.partitionBy("head")  # one row per task
    ranked = groups.withColumns(
        {"_turn": F.row_number().over(own.orderBy("task")) - 1, "_tasks": F.count("*").over(own)}
    )
    plan = groups.sparkSession.range(steps).select(
        F.col("id").alias("step"),
        F.pmod("id", F.lit(heads)).cast("int").alias("head"),
        F.floor(F.col("id") / heads).alias("_round"),
    )
    return (
        plan.join(ranked, "head")
        .filter(F.pmod("_round", F.col("_tasks")) == F.col("_turn"))
        .select(
            "step",
            "head",
            "task",
            F.pmod(F.floor(F.col("_round") / F.col("_tasks")), F.col("n_batches")).cast("bigint").alias("batch_no"),
        )
    )


def covering_steps(groups: DataFrame, heads: int) -> int:
    """Steps in which ``round_robin`` reaches every batch of every group."""
    per_head = groups.groupBy("head").agg((F.count("*") * F.max("n_batches")).alias("_rounds"))
    return heads * (per_head.agg(F.max("_rounds")).first()[0] or 0)


def stride_shards(df: DataFrame, order: list[str], shards: int, fill: dict) -> DataFrame:
    """Row ``i`` goes to shard ``i % shards``; short shards end with fill rows."""
    indexed = with_index(df, order, "_idx").select(
        F.pmod("_idx", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_idx") / shards).cast("bigint").alias("slot"),
        *df.columns,
    )
    total = df.agg(F.count("*").alias("n"))
    # fewer fill rows than shards: the last, partly filled round
    gaps = total.select(
        F.explode(
            F.filter(
                F.sequence(F.col("n"), F.ceil(F.col("n") / shards) * shards),
                lambda i: i < F.ceil(F.col("n") / shards) * shards,
            )
        ).alias("i")
    ).select(
        F.pmod("i", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("i") / shards).cast("bigint").alias("slot"),
        *[F.lit(fill.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns],
    )
    return indexed.unionByName(gaps)
