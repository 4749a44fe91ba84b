"""Column-level text functions: gates, rewrites, sections, sentences, tokens."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import rules
from .collections import bind, index_range

TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SENTENCE_END = r"(?<=[.!?。！？])(?![.!?。！？])|\n"
SPACE = " \t\n\r\f\u000b"

# Markup removal, in order: (pattern, replacement); patterns repeated for nesting.
MARKUP_STRIPS = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", ""),
    (r"<ref[^>]*/>", ""),
    (r"(?s)<ref[^>]*>.*?</ref>", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"\{\{[^{}]*\}\}", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (r"\[\[(?:File|Image|Category):[^\]]*\]\]", ""),
    (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"),
    (r"\[\[([^\]]*)\]\]", "$1"),
    (r"\[https?://[^\s\]]+\s?([^\]]*)\]", "$1"),
    (r"'''?", ""),
    (r"<[^>]+>", ""),
]


def replace_all(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def words(c: Column) -> Column:
    """Whitespace tokens, no empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def tokenize(c: Column, mode: str = "word") -> Column:
    """``word``: letter/digit runs and single symbols; ``space``: whitespace."""
    if mode == "space":
        return words(c)
    if mode != "word":
        raise ValueError(f"unknown tokenizer mode {mode!r}")
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))


def split_sentences(c: Column) -> Column:
    """Sentence strings: split at line ends and after closing punctuation.

    Borders are looked for, not sentences: a negated class of these marks costs
    Java ten times as much a character.
    """
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


# ---- comment gates -------------------------------------------------------------


def topic_match(comment: Column, topics: Iterable[str] = tuple(rules.TOPIC_WORDS)) -> Column:
    return contains_any(comment, topics)


def clean_comment(comment: Column) -> Column:
    return replace_all(comment, [(s, "") for s in rules.TOOL_SIGNATURES])


def comment_ok(comment: Column, min_tokens: int = 3) -> Column:
    return (F.size(tokenize(comment)) >= min_tokens) & ~contains_any(comment, rules.BOT_MARKERS)


def revision_rejected(comment: Column, diff_size: Column, max_size: int) -> Column:
    """No usable diff, no section comment, a bare section title, or a revert."""
    c = strip(comment)
    return (
        (diff_size == 0)
        | (diff_size > max_size)
        | ~F.startswith(c, F.lit("/*"))
        | F.endswith(c, F.lit("*/"))
        | c.rlike(r"(?i)^[^\n]*(revert|undo|undid)")
    )


def comment_blacklisted(comment: Column) -> Column:
    lowered = bind(F.lower(comment), lambda c: contains_any(c, rules.COMMENT_BLACKLIST))
    return lowered | contains_any(comment, rules.COMMENT_MARKERS)


def modify_markup(c: Column) -> Column:
    return F.regexp_replace(replace_all(c, rules.MARKUP_REWRITES), rules.USER_LINK, "")


def rewrite_comment(c: Column, pairs: Iterable[tuple[str, str]] = tuple(rules.COMMENT_REWRITES)) -> Column:
    return modify_markup(replace_all(c, pairs))


def has_url(c: Column) -> Column:
    return contains_any(c, ["http:", "https:"])


def is_talk(comment: Column) -> Column:
    return contains_any(F.lower(comment), rules.TALK_WORDS)


# ---- wiki text -----------------------------------------------------------------


def numeric_references(c: Column) -> Column:
    """``&#233;`` and ``&#xE9;`` as characters; numbers that are no character
    become U+FFFD. An ampersand stays ``&amp;``, for the entities come next."""
    reference = r"(?s)^(\d{1,7}|[xX][0-9a-fA-F]{1,6});(.*)$"

    def char(ref: Column) -> Column:
        hexadecimal = F.conv(F.substring(ref, 2, 6), 16, 10)
        n = F.when(F.lower(F.left(ref, F.lit(1))) == "x", hexadecimal).otherwise(ref).cast("int")
        valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        return F.when(n == 38, "&amp;").when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def part(p: Column, i: Column) -> Column:
        decoded = F.concat(char(F.regexp_extract(p, reference, 1)), F.regexp_extract(p, reference, 2))
        return F.when(i == 0, p).when(p.rlike(reference), decoded).otherwise(F.concat(F.lit("&#"), p))

    return F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(F.split(c, "&#"), part), "")).otherwise(c)


def unescape(c: Column) -> Column:
    """Numeric references and the common entities, natively."""
    return replace_all(numeric_references(c), rules.ENTITIES)


@F.pandas_udf(T.StringType())
def unescape_full(c: pd.Series) -> pd.Series:
    """The whole HTML5 entity table and numeric references."""
    import html

    return c.map(html.unescape, na_action="ignore")


def clean_wiki_text(c: Column, full: bool = False) -> Column:
    bare = replace_all(c, [("[[", ""), ("]]", ""), ("''", "")])
    return unescape_full(bare) if full else unescape(bare)


def strip_markup(c: Column) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, p[0], p[1]), MARKUP_STRIPS, c)


def section_title(comment: Column) -> Column:
    return strip(F.regexp_extract(comment, r"^/\*(.+)\*/(.*)", 1))


def section_comment(comment: Column) -> Column:
    """The comment without its section title."""
    rest = strip(unescape(strip(F.regexp_extract(comment, r"^/\*(.+)\*/(.*)", 2))))
    return F.when(comment.rlike(r"^/\*(.+)\*/(.*)"), rest).otherwise(comment)


def section_text(text: Column, title: Column, compat: bool = False) -> Column:
    """Body of the first section with this title.

    The section ends at the next heading of the same or a higher level; with
    ``compat`` at the next line that holds the heading mark twice. An empty
    title stands for the whole text; unequal heading marks give ''.
    """
    heading = F.concat(F.lit(r"(=+)\s*\Q"), title, F.lit(r"\E\s*(=+)"))

    def body(h: Column) -> Column:
        rest = strip(F.substring(text, F.position(h["whole"], text) + F.length(h["whole"]), F.length(text)))
        level = F.length(h["open"])
        if compat:
            stop = F.concat(h["open"], F.lit(".*"), h["open"])
        else:
            one = F.transform(
                F.sequence(F.lit(1), level),
                lambda k: F.concat(
                    F.lit("={"), k.cast("string"), F.lit(r"}[^=\n](?:[^\n]*[^=\n])?={"), k.cast("string"), F.lit("}")
                ),
            )
            stop = F.concat(F.lit("(?m)^(?:"), F.array_join(one, "|"), F.lit(")[ \\t]*$"))
        cut = bind(
            rest,
            lambda r: bind(
                F.regexp_instr(r, stop),
                lambda at: F.when(at > 0, strip(F.substring(r, F.lit(1), at - 1))).otherwise(r),
            ),
        )
        return F.when((level == 0) | (h["open"] != h["close"]), F.lit("")).otherwise(cut)

    found = F.struct(
        *[
            F.call_function("regexp_extract", text, heading, F.lit(i)).alias(name)
            for i, name in enumerate(["whole", "open", "close"])
        ]
    )
    return F.when(title == "", text).otherwise(bind(found, body))


def strip_brackets(line: Column) -> Column:
    has_l, has_r = F.contains(line, F.lit("-LRB-")), F.contains(line, F.lit("-RRB-"))
    return (
        F.when(has_l & has_r, F.regexp_replace(line, r"-.*?LRB.*?-.*?-.*?RRB.*?-", ""))
        .when(has_l | has_r, replace_all(line, [("-LRB-", '"'), ("-RRB-", '"')]))
        .otherwise(line)
    )


def sentence_ok(c: Column) -> Column:
    return ~contains_any(c, [rules.LABEL_SEP, rules.OP_SEP])


def normalize_line(c: Column) -> Column:
    """Drop immediately repeated tokens, rewrite quotes and dashes, lower-case."""
    distinct = bind(
        F.split(c, " "),
        lambda t: F.transform(
            F.filter(
                index_range(F.size(t)), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1))
            ),
            lambda i: F.get(t, i),
        ),
    )
    return F.lower(replace_all(F.array_join(distinct, " "), rules.TOKEN_REWRITES))


def normalize_number(token: Column) -> Column:
    starts_with_digit = (token >= "0") & (token < ":")  # the character after 9
    return F.when(starts_with_digit, F.lit(rules.NUMBER)).otherwise(token)


def diff_url(title: Column, rev_id: Column, parent_id: Column, host: str) -> Column:
    return F.concat(
        F.lit(host + "/w/index.php?title="),
        F.replace(title, F.lit(" "), F.lit("%20")),
        F.lit("&type=revision&diff="),
        rev_id.cast("string"),
        F.lit("&oldid="),
        parent_id.cast("string"),
    )
