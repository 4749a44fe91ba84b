"""Revision dumps read by splits: no page and no file has to fit in one task.

A dump is cut at ``</revision>`` by Spark's text source, which splits plain and
bzip2 files into byte ranges. A piece knows its revision, but the page it belongs
to was opened some pieces ago, maybe several splits before. A segmented prefix scan
gives it back:

1. each split is summed up in one row: how many revisions it holds, the last page
   it opens, and how many revisions follow that opening,
2. over these rows (one per split) the state before each split is worked out: the
   open page, and how many of its revisions came before,
3. a second scan starts every split with its state and counts on, piece by piece.

The table of splits is all that is sorted, shuffled or broadcast; the XML is read
twice and stays where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as tx

_END = "</revision>"


def revision_fields(xml: Column) -> Column:
    """Fields of one ``<revision>`` element held as text. Absent and self-closing
    elements are null, entities are decoded once."""

    def field(pattern: str) -> Column:
        return F.when(xml.rlike(f"(?s){pattern}"), tx.unescape(F.regexp_extract(xml, f"(?s){pattern}", 1)))

    contributor = r"<contributor[^>]*>.*?"
    return F.struct(
        field(r"^.*?<id>(\d+)</id>").cast("bigint").alias("rev_id"),
        field(r"<parentid>(\d+)</parentid>").cast("bigint").alias("parent_id"),
        F.try_to_timestamp(field(r"<timestamp>([^<]*)</timestamp>")).alias("timestamp"),
        field(contributor + r"<username>([^<]*)</username>").alias("user_name"),
        field(contributor + r"<id>(\d+)</id>.*?</contributor>").cast("bigint").alias("user_id"),
        field(contributor + r"<ip>([^<]*)</ip>").alias("user_ip"),
        field(r"<comment[^>]*>([^<]*)</comment>").alias("comment"),
        field(r"<text[^>]*>([^<]*)</text>").alias("text"),
    )


def pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What lies between the ends of revisions: ``file, block, value``, whether it
    holds a revision, and the page it opens (of several, the last). Text in dumps
    is escaped, so tags are only ever tags."""
    raw = spark.read.option("lineSep", _END).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_m"),
    )
    head = F.substring_index("value", "<revision>", 1)  # what comes before the revision
    page = F.when(head.rlike(r"<page[\s>]"), F.regexp_extract(head, r"(?s)^.*<page[\s>](.*)$", 1))
    named = raw.withColumn("_page", page)
    title, number = (F.col("_page").rlike(p) for p in ("<title>", r"<id>\d+</id>"))
    return named.select(
        "file",
        "block",
        "_m",
        F.contains("value", F.lit("<revision>")).alias("_rev"),
        F.col("_page").isNotNull().alias("_opens"),
        F.when(title, F.regexp_extract("_page", r"<title>([^<]*)</title>", 1)).alias("_title"),
        F.when(number, F.regexp_extract("_page", r"<id>(\d+)</id>", 1).cast("bigint")).alias("_id"),
        "value",
    )


def states(found: DataFrame) -> DataFrame:
    """The page that is open where each split begins: ``file, block, _was_title,
    _was_id, _done`` (revisions of it so far). One row per split."""
    opened = F.when(F.col("_opens"), F.col("_m"))
    per_split = found.groupBy("file", "block").agg(
        F.count_if("_rev").alias("_n"),
        F.max(F.when(F.col("_rev"), F.col("_m"))).alias("_last"),
        F.max(opened).alias("_at"),
        F.max_by(F.struct("_title", "_id"), opened).alias("_page"),
    )
    # numbers of a scan follow one another inside a split, and all pieces but a file's tail hold a revision
    after = F.greatest(F.lit(0), F.col("_last") - F.col("_at") + 1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = per_split.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    counted = counted.withColumn("_first", F.when(F.col("_at").isNotNull(), F.col("_before") + F.col("_n") - F.coalesce(after, F.lit(0))))
    counted = counted.withColumn("_open", F.when(F.col("_at").isNotNull(), F.col("_page")))
    return counted.select(
        "file",
        "block",
        F.last("_open", ignorenulls=True).over(earlier).alias("_was"),
        (F.col("_before") - F.coalesce(F.last("_first", ignorenulls=True).over(earlier), F.lit(0))).alias("_done"),
    ).select("file", "block", F.col("_was._title").alias("_was_title"), F.col("_was._id").alias("_was_id"), "_done")


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order with their split's state -> revisions with page and number."""
    split = title = page = None
    count = 0
    for batch in batches:
        keep, titles, pages, counts = [], [], [], []
        columns = (batch.column(k).to_pylist() for k in range(9))
        for row, (file, block, rev, opens, new_title, new_page, was_title, was_page, done) in enumerate(zip(*columns)):
            if (file, block) != split:
                split, title, page, count = (file, block), was_title, was_page, done
            if opens:
                title, page, count = new_title, new_page, 0
            if rev:
                keep.append(row)
                titles.append(title)
                pages.append(page)
                counts.append(count)
                count += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(pages, pa.int64()), pa.array(titles, pa.string()), pa.array(counts, pa.int64()), batch.column(9).take(pa.array(keep, pa.int64()))],
            names=["page_id", "page_title", "rev_ord", "value"],
        )


def read_revisions(spark: SparkSession, path: str | list[str], spread: int | None = None) -> DataFrame:
    """Revisions of (bzip2 or plain) XML dumps, one row each: ``page_id, page_title,
    rev_id, parent_id, rev_ord, timestamp, user_name, user_id, user_ip, comment,
    text``.

    ``rev_ord`` counts from 0 inside a page element. A file that does not split
    (gzip) is one task; ``spread`` deals the parsed revisions evenly over that many
    tasks. Defined results: a revision outside any page has no page id and title
    and counts on from the file's start; pages without revisions give no row; a
    file without revisions gives none; a timestamp that is none is null.
    """
    found = pieces(spark, path)
    started = found.join(F.broadcast(states(found)), ["file", "block"])
    ordered = started.select("file", "block", "_rev", "_opens", "_title", "_id", "_was_title", "_was_id", "_done", "value")
    held = ordered.mapInArrow(_carried, "page_id bigint, page_title string, rev_ord bigint, value string")
    xml = F.concat(F.lit("<revision>"), F.substring_index("value", "<revision>", -1), F.lit(_END))
    parsed = held.select("page_id", tx.unescape(F.col("page_title")).alias("page_title"), "rev_ord", revision_fields(xml).alias("r"))
    flat = parsed.select(
        "page_id", "page_title", "r.rev_id", "r.parent_id", "rev_ord", "r.timestamp", "r.user_name", "r.user_id", "r.user_ip", "r.comment", "r.text"
    )
    return flat.repartition(spread) if spread else flat
