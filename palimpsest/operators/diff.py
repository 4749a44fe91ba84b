"""Changed sentences of a revision pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import sequence, text as tx
from ..functions.collections import bound


@bound(2)
def pick(items: Column, positions: Column) -> Column:
    return F.transform(positions, lambda i: F.get(items, i))


def _diffed(df: DataFrame, a: str, b: str) -> DataFrame:
    ops = sequence.diff_ops(a, b)
    return (
        df.withColumn("_ops", ops)
        .withColumn(f"{a}_at", sequence.changed(F.col("_ops"), "i"))
        .withColumn(f"{b}_at", sequence.changed(F.col("_ops"), "j"))
        .drop("_ops")
    )


def two_stage_diff(pairs: DataFrame) -> DataFrame:
    """Line diff, then a sentence diff of the changed lines.

    Adds ``src`` and ``tgt``: the changed sentences of each side. Pairs whose
    second diff touches only one side (pure insertions or deletions) drop out.
    """
    lines = pairs.filter(F.col("src_text") != F.col("tgt_text")).withColumns(
        {"_sl": F.split("src_text", "\n"), "_tl": F.split("tgt_text", "\n")}
    )
    staged = _diffed(lines, "_sl", "_tl").filter((F.size("_sl_at") > 0) | (F.size("_tl_at") > 0))
    sents = staged.withColumns(
        {
            f"_{x}s": tx.split_sentences(tx.strip(F.array_join(pick(F.col(f"_{x}l"), F.col(f"_{x}l_at")), " ")))
            for x in "st"
        }
    )
    return (
        _diffed(sents, "_ss", "_ts")
        .filter((F.size("_ss_at") > 0) & (F.size("_ts_at") > 0))
        .withColumn("src", F.array_join(pick(F.col("_ss"), F.col("_ss_at")), " "))
        .withColumn("tgt", F.array_join(pick(F.col("_ts"), F.col("_ts_at")), " "))
        .drop(*[f"_{x}{k}{a}" for x in "st" for k in "ls" for a in ("", "_at")])
    )
