"""Writers: JSON Lines, aligned text files, per-cluster folders and text, XML dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "append", chunk: int = 0) -> None:
    """Text lines; ``chunk`` starts a new file every so many rows."""
    out = df.select(F.col(column).alias("value")).write.mode(mode)
    if chunk:
        out = out.option("maxRecordsPerFile", chunk)
    out.text(path)


def one_line(c: Column) -> Column:
    """A value as one text line."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


def write_parallel(df: DataFrame, order: str, source: str, target: str, src: str = "src", tgt: str = "tgt") -> None:
    """Two aligned text outputs: the sorted rows are fixed once, so both writes
    see the same rows in the same files."""
    placed = cut_lineage(
        df.select(order, one_line(F.col(src)).alias("s"), one_line(F.col(tgt)).alias("t"))
        .repartitionByRange(order)
        .sortWithinPartitions(order)
    )
    write_lines(placed, "s", source)
    write_lines(placed, "t", target)


def write_by_cluster(df: DataFrame, path: str, cluster: str = "cluster", rows_per_file: int = 1_000_000) -> None:
    """One folder per cluster; a big cluster spreads over many tasks and files."""
    df.write.partitionBy(cluster).option("maxRecordsPerFile", rows_per_file).mode("append").json(path)


def write_parallel_by_cluster(
    df: DataFrame, order: str, path: str, cluster: str = "cluster", src: str = "src", tgt: str = "tgt", rows_per_file: int = 1_000_000
) -> None:
    """Aligned text per cluster: ``path/src/cluster=c`` and ``path/tgt/cluster=c`` hold
    the same lines in the same files. The rows are placed once; a big cluster spans
    tasks and files. A second run replaces the clusters it has and leaves the
    others; ``order`` is unique inside a cluster."""
    keys = ["_cluster", "_order"]
    placed = cut_lineage(
        df.select(F.col(cluster).alias("_cluster"), F.col(order).alias("_order"), one_line(F.col(src)).alias("src"), one_line(F.col(tgt)).alias("tgt"))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
    )
    for side in ("src", "tgt"):
        lines = placed.sortWithinPartitions(*keys).select(F.col("_cluster").alias(cluster), F.col(side).alias("value"))
        out = lines.write.partitionBy(cluster).option("maxRecordsPerFile", rows_per_file)
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").text(f"{path}/{side}")


def write_revisions_xml(pages: DataFrame, path: str, compression: str = "bzip2") -> None:
    """Pages (``title, id, revision``) as a compressed dump, row tag ``page``."""
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option(
        "compression", compression
    ).save(path)
