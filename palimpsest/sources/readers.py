"""Readers: revision dumps, JSON Lines, parallel text, tag lines, manifests."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx
from ..operators.ordering import with_index
from .dumps import read_revisions, revision_fields

MANIFEST_SCHEMA = "jobs map<string, struct<files: map<string, struct<url:string, md5:string, size:bigint>>>>"


# ---- manifests -----------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str, kind: str = "bz2", host: str = "", local: str = "") -> DataFrame:
    """``name, url, md5, size, target`` of the history dumps a status file lists."""
    job = f"metahistory{kind}dump"
    raw = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    return raw.select(F.explode(F.col("jobs")[job]["files"]).alias("name", "f")).select(
        "name",
        F.concat(F.lit(host), F.col("f.url")).alias("url"),
        F.col("f.md5").alias("md5"),
        F.col("f.size").alias("size"),
        F.concat(F.lit(local), F.col("name")).alias("target"),
    )


def slice_manifest(manifest: DataFrame, start: int = 1, end: int = 0) -> DataFrame:
    """1-based positions ``start..end`` in name order; ``end <= 0`` means to the end."""
    numbered = with_index(manifest, ["name"], "_i").withColumn("position", F.col("_i") + 1).drop("_i")
    keep = F.col("position") >= start
    if end > 0:
        keep = keep & (F.col("position") <= end)
    return numbered.filter(keep)


def audit_files(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds ``status``: pass, missed (no file) or crashed (other checksum)."""
    have = listing.select("name", F.col("md5").alias("_have"))
    return manifest.join(have, "name", "left").withColumn(
        "status",
        F.when(F.col("_have").isNull(), "missed").when(F.col("_have") == F.col("md5"), "pass").otherwise("crashed"),
    ).drop("_have")


def checksum_listing(spark: SparkSession, path: str, chunk: int = 40_960_000) -> DataFrame:
    """``name, md5`` of every file below a shared folder, hashed in chunks: a
    file is never held in memory and may exceed the size limit of one value."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def digest(batches):
        from pyarrow.fs import FileSystem

        for pdf in batches:
            out = []
            for uri in pdf["path"]:
                h = hashlib.md5()
                fs, name = FileSystem.from_uri(uri)
                with fs.open_input_stream(name) as f:
                    while block := f.read(chunk):
                        h.update(block)
                out.append(h.hexdigest())
            yield pdf.assign(md5=out)[["path", "md5"]]

    # one hash per task at a time, whatever the number of listed files
    tasks = files.repartition(spark.sparkContext.defaultParallelism, "path")
    return tasks.mapInPandas(digest, "path string, md5 string").select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "md5"
    )


# ---- JSON Lines and text -------------------------------------------------------


def part_order(file: Column) -> Column:
    """File names in written order: ``part-100000`` follows ``part-99999``."""
    name = r"^(.*/part-)(\d+)([^/]*)$"
    numbered = F.concat(F.regexp_extract(file, name, 1), F.lpad(F.regexp_extract(file, name, 2), 20, "0"), F.regexp_extract(file, name, 3))
    return F.when(file.rlike(name), numbered).otherwise(file)


def line_index(df: DataFrame) -> DataFrame:
    """Adds ``line_no`` (0-based over the files in written order) and
    ``line_in_file`` to all rows of a scan, with ``file, block`` and the
    ``monotonically_increasing_id`` of the scan as ``_m``.

    A block is read by one task in order, so a row's number in it is the distance
    to the block's first ``_m``. Only the table of blocks, one row per input
    split, is sorted and broadcast; no text moves.
    """
    per_block = df.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    over_all = Window.orderBy(part_order(F.col("file")), "block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select(
        "file",
        "block",
        "_first",
        F.coalesce(F.sum("_n").over(over_all), F.lit(0)).alias("_all"),
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_file"),
    )
    inside = F.col("_m") - F.col("_first")
    return (
        df.join(F.broadcast(bases), ["file", "block"])
        .withColumn("line_no", (F.col("_all") + inside).cast("bigint"))
        .withColumn("line_in_file", (F.col("_file") + inside).cast("bigint"))
        .drop("_first", "_all", "_file", "_m", "block")
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, value, line_no, line_in_file`` of (compressed) text files."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_m"),
    )
    return line_index(raw)


def read_jsonl(
    spark: SparkSession, path: str | list[str], text_field: str = "text", bos: str = "", json: bool | None = None
) -> DataFrame:
    """``file, id, text, token_count``; rows without text drop out after numbering.

    ``json=True``: a line that is no JSON object is an error. ``json=False``: each
    line is its own text. By default lines that parse as objects are read as
    such and all others, braces or not, are their own text.
    """
    lines = read_lines(spark, path)
    line = F.col("value")
    parsed = F.get_json_object("value", f"$.{text_field}")
    is_object = line.rlike(r"^\s*\{") & F.get_json_object("value", "$").isNotNull()
    if json:
        fault = F.concat(F.lit("no JSON object in "), F.col("file"), F.lit(", line "), F.col("line_in_file").cast("string"))
        text = F.when(is_object, parsed).when(F.trim(line) != "", F.raise_error(fault).cast("string"))
    else:
        text = line if json is False else F.when(is_object, parsed).otherwise(line)
    return (
        lines.withColumn("text", text)
        .filter(F.col("text").isNotNull() & (F.col("text") != ""))
        .withColumn("token_count", F.size(tx.words(F.col("text"))))
        .withColumn("text", F.concat(F.lit(bos), F.col("text")))
        .select("file", F.col("line_in_file").alias("id"), "text", "token_count")
    )


def read_parallel(spark: SparkSession, source: str, target: str) -> DataFrame:
    """``line_no, src, tgt`` of two line-aligned files; blank pairs drop out and
    files of unequal length raise."""
    a = read_lines(spark, source).select("line_no", F.trim("value").alias("src"))
    b = read_lines(spark, target).select("line_no", F.trim("value").alias("tgt"))
    # totals, not an outer join: the blank-line filter would turn that into an
    # inner join and the guard would never see an unmatched line
    same_length = a.agg(F.count("*")).scalar() == b.agg(F.count("*")).scalar()
    keep = F.when(same_length, (F.col("src") != "") & (F.col("tgt") != "")).otherwise(
        F.raise_error(F.lit("parallel files differ in length")).cast("boolean")
    )
    return a.join(b, "line_no").filter(keep)


def read_tag_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select("line_no", F.split("value", " ").alias("tags"))


def sample_files(paths: Iterable[str], n: int, seed: int, replace: bool = False) -> list[str]:
    """Reproducible choice from a file listing (names only, made on the driver)."""
    names = sorted(paths)
    rng = random.Random(seed)
    return [rng.choice(names) for _ in range(n)] if replace else rng.sample(names, min(n, len(names)))


_PLACE = ["_folder", "_part", "_chunk", "_line"]  # of a line, the same on both sides


def read_parallel_by_cluster(spark: SparkSession, path: str, cluster: str = "cluster") -> DataFrame:
    """``cluster, src, tgt`` of aligned text per cluster. Files are matched by the
    number in their names, lines by their place; a line without its other half is an
    error."""

    def side(name: str) -> DataFrame:
        raw = spark.read.text(f"{path.rstrip('/')}/{name}").select(
            F.col(f"`{cluster}`").cast("string").alias(cluster),
            F.col("value").alias(name),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("_m"),
        )
        place = [F.regexp_extract("file", p, 1) for p in (rf"/{cluster}=([^/]*)/", r"part-(\d+)-", r"[.-]c(\d+)\.txt")]
        keys = (c.alias(k) for c, k in zip([*place, F.col("line_in_file")], _PLACE))
        return line_index(raw).select(*keys, name, *([cluster] if name == "src" else []))

    both = side("src").join(side("tgt"), _PLACE, "full_outer")
    whole = F.col("src").isNotNull() & F.col("tgt").isNotNull()
    keep = F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("source and target lines differ")).cast("boolean"))
    return both.filter(keep).select(cluster, "src", "tgt")


def _task_columns(columns: list[str], role: str) -> tuple[str, str, str | None]:
    """Tokens, labels and mask by convention: ``tokens`` (else the first column),
    ``<role>_tags`` (else the second), ``mask`` if there is one."""
    text = "tokens" if "tokens" in columns else columns[0]
    label = f"{role}_tags" if f"{role}_tags" in columns else [c for c in columns if c != "mask"][1]
    return text, label, "mask" if "mask" in columns else None


def _as_list(df: DataFrame, name: str) -> Column:
    """An array of strings: text is split at spaces."""
    c = F.col("`" + name + "`")
    return c.cast("array<string>") if dict(df.dtypes)[name].startswith("array") else F.split(c.cast("string"), " ")


_BAD = "_corrupt_record"


def read_task_file(spark: SparkSession, path: str, role: str = "text", kind: str | None = None) -> DataFrame:
    """``tokens, labels, mask, bad`` of one task's csv (with a header, quotes doubled
    inside quotes, a record a line), JSON lines or text (``tokens``, tab, ``labels``) file or folder; ``kind`` is taken from the
    name's ending unless given. Lines that do not fit are rows with ``bad`` only."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        schema = spark.read.csv(path, header=True, escape='"').schema.add(_BAD, "string")
        # with pruned columns a line of too many would pass
        whole = spark.read.schema(schema).option("columnNameOfCorruptRecord", _BAD).option("columnPruning", "false")
        df = whole.csv(path, header=True, escape='"')
    elif kind in ("json", "jsonl"):
        df = spark.read.option("columnNameOfCorruptRecord", _BAD).json(path)
        df = df if _BAD in df.columns else df.withColumn(_BAD, F.lit(None).cast("string"))
    elif kind in ("txt", "text"):
        parts = F.split("value", "\t")
        fits = F.size(parts) == 2
        df = spark.read.text(path).select(
            F.when(fits, parts[0]).alias("tokens"), F.when(fits, parts[1]).alias(f"{role}_tags"), F.when(~fits, F.col("value")).alias(_BAD)
        )
    else:
        raise ValueError(f"no task file: {path}")
    text, label, mask = _task_columns([c for c in df.columns if c != _BAD], role)
    short = F.col(_BAD).isNull() & (F.col(f"`{text}`").isNull() | F.col(f"`{label}`").isNull())
    bad = F.when(short, F.lit("no tokens or labels")).otherwise(F.col(_BAD))
    good = bad.isNull()
    return df.select(
        F.when(good, _as_list(df, text)).alias("tokens"),
        F.when(good, _as_list(df, label)).alias("labels"),
        (F.when(good, _as_list(df, mask)) if mask else F.lit(None).cast("array<string>")).alias("mask"),
        bad.alias("bad"),
    )


def load_task_files(
    spark: SparkSession, train: list[str], valid: list[str], role: str = "text", debug_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``task, split, tokens, labels, mask`` of parallel lists of training and
    validation files, and ``task, split, bad`` of the lines that do not fit.
    ``debug_rows`` keeps so many good rows of each file (a limit, no sort)."""
    if len(train) != len(valid):
        raise ValueError("each task has one training and one validation file")
    good, bad = [], []
    for split, paths in (("train", train), ("validation", valid)):
        for task, path in enumerate(paths):
            df = read_task_file(spark, path, role).select(F.lit(task).alias("task"), F.lit(split).alias("split"), "*")
            fit = df.filter("bad is null").drop("bad")
            good.append(fit.limit(debug_rows) if debug_rows else fit)
            bad.append(df.filter("bad is not null").select("task", "split", "bad"))
    return reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, bad)


def load_tasks(
    frames: list[DataFrame], role: str = "text", debug_rows: int | None = None
) -> DataFrame:
    """Union of per-task tables, tagged with their position.

    Column names are found by convention: ``tokens`` (else the first column)
    and ``mask`` or ``<role>_tags`` (else the second).
    """
    parts = []
    for i, df in enumerate(frames):
        cols = df.columns
        text = "tokens" if "tokens" in cols else cols[0]
        label = next((c for c in ("mask", f"{role}_tags") if c in cols), cols[1])
        part = df.select(F.lit(i).alias("task"), F.col(text).alias("tokens"), F.col(label).alias("labels"))
        parts.append(part.limit(debug_rows) if debug_rows else part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


__all__ = [
    "read_manifest", "slice_manifest", "audit_files", "checksum_listing", "read_revisions",
    "revision_fields", "read_lines", "read_jsonl", "read_parallel",
    "read_tag_lines", "sample_files", "load_tasks", "read_parallel_by_cluster", "read_task_file", "load_task_files", "line_index", "MANIFEST_SCHEMA",
]
