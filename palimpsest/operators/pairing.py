"""Revision gates, parent pairing and page-ordered views of a revision table.

A revision table has ``page_id, page_title, rev_id, parent_id, rev_ord,
comment, text`` (further columns are carried along).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules, text as tx
from ..functions.collections import bind, present
from .ordering import group_rank, halo_blocks, previous_in_group, with_index

HOST = "https://en.wikipedia.org"


def gate_comments(
    revisions: DataFrame, topics: Iterable[str] = tuple(rules.TOPIC_WORDS), min_size: int = 0
) -> DataFrame:
    """Keep revisions whose comment names a topic before and after its section
    title is cut off; adds ``title`` and replaces ``comment`` by the rest."""
    topics = list(topics)
    cleaned = tx.clean_comment(F.col("comment"))
    return (
        revisions.filter(tx.topic_match(F.col("comment"), topics))
        .withColumn("title", tx.section_title(cleaned))
        .withColumn("comment", tx.section_comment(cleaned))
        .filter(tx.topic_match(F.col("comment"), topics) & (F.char_length("comment") >= min_size))
    )


def sampled(key: Column, ratio: float, seed: int = 0) -> Column:
    """Bernoulli choice by key hash: the same after a retry or on another layout."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(ratio * 1_000_000)


def pair_with_parent(
    kept: DataFrame,
    carry: Iterable[str] = ("title", "text"),
    ratio: float = 1.0,
    seed: int = 0,
    within: Iterable[str] = (),
) -> DataFrame:
    """Each kept revision next to its parent, if the parent was kept (and sampled).

    An equi-join on the revision id, and on the columns ``within`` (the page)
    where ids are unique inside those only; both sides are narrowed to the columns
    asked for before the shuffle.
    """
    carry, within = list(carry), list(within)
    parent = kept.select(
        F.col("rev_id").alias("_pid"),
        *[F.col(c).alias(f"_in_{c}") for c in within],
        *[F.col(c).alias(f"parent_{c}") for c in carry],
    )
    if ratio < 1.0:
        parent = parent.filter(sampled(F.col("_pid"), ratio, seed))
    on = F.col("parent_id") == F.col("_pid")
    for c in within:
        on = on & (F.col(c) == F.col(f"_in_{c}"))
    return kept.join(parent, on).drop("_pid", *[f"_in_{c}" for c in within])


def sections_of_pairs(pairs: DataFrame, max_chars: int | None = None, compat: bool = False) -> DataFrame:
    """Cut the commented section on both sides and strip its markup; pairs with
    an empty side are left out, and only on request those with a side of
    ``max_chars`` or more."""
    def body(text: str) -> Column:
        return tx.strip_markup(tx.section_text(F.col(text), F.col("title"), compat))

    def usable(sides: Column) -> Column:
        sizes = [F.char_length(sides[c]) for c in ("src_text", "tgt_text")]
        ok = (sizes[0] > 0) & (sizes[1] > 0)
        if max_chars is not None:
            ok = ok & (sizes[0] < max_chars) & (sizes[1] < max_chars)
        return F.when(ok, sides)

    sides = F.struct(body("parent_text").alias("src_text"), body("text").alias("tgt_text"))
    return pairs.drop("src_text", "tgt_text").select("*", present(bind(sides, usable)))


def with_diff_url(pairs: DataFrame, host: str = HOST) -> DataFrame:
    return pairs.withColumn(
        "diff_url", tx.diff_url(F.col("page_title"), F.col("rev_id"), F.col("parent_id"), host)
    )


def previous_kept(kept: DataFrame, carry: Iterable[str] = ("rev_id",)) -> DataFrame:
    """The kept revision before each one on its page."""
    return previous_in_group(kept, ["page_id"], ["rev_ord"], list(carry))


def comment_rows(kept: DataFrame, min_tokens: int = 3) -> DataFrame:
    """Every valid comment of each page with its number: ``page_id, rev_id,
    comment_no, comment``.

    The running list of a revision is the rows of its page up to its own number.
    """
    valid = kept.filter(tx.comment_ok(F.col("comment"), min_tokens))
    ranked = group_rank(valid.select("page_id", "rev_ord", "rev_id", "comment"), ["page_id"], ["rev_ord"], "_rank")
    return ranked.select("page_id", "rev_id", (F.col("_rank") + 1).alias("comment_no"), "comment")


def page_comments(kept: DataFrame, min_tokens: int = 3, last: int = 10) -> DataFrame:
    """Running valid comments of each page: their number so far and the last
    ``last`` of them (newest last).

    Older comments are not in the window; ``comment_rows`` keeps them all.
    """
    valid = kept.filter(tx.comment_ok(F.col("comment"), min_tokens))
    ranked = group_rank(valid.select("page_id", "rev_ord", "rev_id", "comment"), ["page_id"], ["rev_ord"], "comment_no")
    indexed = with_index(ranked, ["page_id", "rev_ord"], "_idx")
    w = Window.partitionBy("_block").orderBy("_idx").rowsBetween(-(last - 1), 0)
    item = F.struct("page_id", "comment")
    page = F.col("page_id")
    return (
        halo_blocks(indexed, "_idx", last - 1, 0)
        .withColumn("_seen", F.collect_list(item).over(w))
        .filter("_own")
        .select(
            "page_id",
            "rev_id",
            (F.col("comment_no") + 1).alias("n_comments"),
            F.transform(
                F.filter("_seen", lambda s: s["page_id"] == page), lambda s: s["comment"]
            ).alias("recent"),
        )
    )


def earlier_comments(kept: DataFrame, min_tokens: int = 3, k: int = 10) -> DataFrame:
    """The ``k`` valid comments before each one; the first of a page has none."""
    return page_comments(kept, min_tokens, k + 1).select(
        "page_id",
        "rev_id",
        F.slice("recent", 1, F.size("recent") - 1).alias("negatives"),
    )


def negative_comments(kept: DataFrame, min_tokens: int = 3, k: int = 10) -> DataFrame:
    """Up to ``k`` other comments of the same page, earlier and later ones: the
    nearest by number (the earlier of two), in page order. A page with more than
    ``k`` valid comments gives each of them ``k``, any other page all others."""
    valid = kept.filter(tx.comment_ok(F.col("comment"), min_tokens))
    indexed = with_index(valid.select("page_id", "rev_ord", "rev_id", "comment"), ["page_id", "rev_ord"], "_idx")
    w = Window.partitionBy("_block").orderBy("_idx").rowsBetween(-k, k)
    page, own = F.col("page_id"), F.col("_idx")
    others = F.filter("_near", lambda s: (s["page_id"] == page) & (s["at"] != own))
    by_distance = F.transform(
        others, lambda s: F.struct(F.abs(s["at"] - own).alias("d"), s["at"].alias("at"), s["comment"].alias("comment"))
    )
    picked = F.slice(F.sort_array(by_distance), 1, k)
    in_order = F.sort_array(F.transform(picked, lambda s: F.struct(s["at"].alias("at"), s["comment"].alias("comment"))))
    return (
        halo_blocks(indexed, "_idx", k, k)
        .withColumn("_near", F.collect_list(F.struct("page_id", F.col("_idx").alias("at"), "comment")).over(w))
        .filter("_own")
        .select("page_id", "rev_id", F.transform(in_order, lambda s: s["comment"]).alias("negatives"))
    )
