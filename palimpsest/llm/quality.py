"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and words in repeated five-word
windows. The verdict then compares two histograms of the document with language
references by Jensen-Shannon distance (base 2, 0 to 1): the classes of its
characters, and its most common function words against all other words. A
document is close if one language is close; documents below a minimum length
are not judged by distance, since short histograms say little.

Only English, French, German and Spanish have references. A text in which none of
them is recognised (few of its words listed, or only one or two forms) is judged
by its characters alone. Texts with a symbol in every fifth word, such as tables
of made-up words, still have to meet the word distance. Scripts without spaces
between words (two bytes a character and more, over the whole text) are judged by
the shares of their other characters.

Every number comes from the row itself: one scan, no shuffle, no Python.

Defined results: null and empty texts have no words and fail the base rule;
very long texts are read whole; repeated rows get equal verdicts; an empty table
gives an empty result; other columns pass through ``keep`` whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.collections import bind, index_range
from .common import free_name

WINDOW = 5
BLANK = r"\x20\x09-\x0D"
MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of words in repeated windows
JUDGED_CHARS = 200
JUDGED_WORDS = 60
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.30
LISTED_SHARE = 50  # one listed word among so many, or the language is not recognised
LISTED_FORMS = 3  # fewer forms, as Hungarian "a", are no sign of a language either,
LONE_SHARE = 5  # unless they are one word among so many
WIDE = 2  # bytes per character from which a script is taken to have no spaces between words
SYMBOL_SHARE = 5  # one symbol for so many words: not prose of an unlisted language

#: Characters of the classes; all other characters are one class more.
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\n\x0b\x0c\r",
    "stop": ".,;:!?'\"()-",
    "symbol": "#*$%&|<>@=_+~^{}[]\\/`",
}
#: Shares of the classes in plain prose, the rest (mostly lower-case letters) last.
PROSE = {"upper": 0.025, "digit": 0.005, "space": 0.16, "stop": 0.025, "symbol": 0.0025, "rest": 0.7825}
#: Frequent function words of each language and their shares of all words.
COMMON = {
    "en": {"the": 0.07, "of": 0.035, "and": 0.03, "to": 0.025, "a": 0.02, "in": 0.02, "is": 0.012, "that": 0.011},
    "fr": {"de": 0.06, "la": 0.03, "le": 0.025, "et": 0.02, "les": 0.018, "en": 0.015, "des": 0.015, "un": 0.012},
    "de": {"der": 0.045, "die": 0.035, "und": 0.03, "in": 0.02, "den": 0.015, "von": 0.012, "zu": 0.012, "das": 0.012},
    "es": {"de": 0.06, "la": 0.035, "que": 0.028, "el": 0.026, "en": 0.024, "y": 0.022, "los": 0.015, "las": 0.012},
}
LISTED = sorted({w for words in COMMON.values() for w in words})


def divergence(p: list[Column], q: list[float]) -> Column:
    """Jensen-Shannon distance of two histograms that each add up to one."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.ln(x * 2 / (x + y))).otherwise(0.0)

    total = F.lit(0.0)
    for x, y in zip(p, q):
        total = total + part(x, F.lit(y)) + part(F.lit(y), x)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / (2 * math.log(2)))


def _repeat_words(h: Column) -> Column:
    """Words inside windows whose hash occurs more than once, from one hash per window."""
    numbered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        twin = lambda i: F.coalesce(F.get(s, i)["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(
            F.get(s, i)["h"] == F.get(s, i + 1)["h"], F.lit(False)
        )
        return F.sort_array(F.transform(F.filter(index_range(F.size(s)), twin), lambda i: F.get(s, i)["i"]))

    def covered(p: Column) -> Column:
        own = F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    return bind(bind(numbered, positions), covered)


def measured(docs: DataFrame, text_col: str = "text", name: str = "_q") -> DataFrame:
    """Adds a struct ``name`` with the counts, the two distances and the verdicts."""
    names = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # one pass leaves the characters of the listed classes, a few of which are counted again
    listed = "[^" + re.escape("".join(CLASSES.values())) + "]+"
    words = F.array_remove(F.split(text, f"[{BLANK}]"), "")
    every = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    step = docs.select(every, text.alias("_t"), words.alias("_w"), F.regexp_replace(text, listed, "").alias("_k"))
    step = step.select("_row", "_t", "_w", F.char_length("_k").alias("_listed"), F.regexp_replace("_k", f"[{BLANK}]+", "").alias("_k"))

    longest = max(len(w.encode()) for w in LISTED)  # a cheap test before the list
    forms = sorted({f for w in LISTED for f in (w, w.capitalize(), w.upper())})
    five = lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(WINDOW)])
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    among = lambda chars: (F.char_length("_k") - F.char_length(F.translate("_k", chars, ""))).cast("bigint")
    step = step.select(
        "_row",
        "_t",
        F.size("_w").cast("bigint").alias("n_words"),
        F.transform(index_range(F.size("_w") - (WINDOW - 1)), five).alias("_h"),
        lines.alias("_l"),
        F.split(F.lower(F.array_join(F.filter("_w", lambda w: (F.octet_length(w) <= longest) & w.isin(forms)), " ")), " ").alias("_c"),
        F.char_length("_t").cast("bigint").alias("_n"),
        (F.octet_length("_t") >= WIDE * F.char_length("_t")).alias("_wide"),
        *[((F.col("_listed") - F.char_length("_k")).cast("bigint") if name == "space" else among(chars)).alias(f"_{name}") for name, chars in CLASSES.items()],
        among("#*$%&|<>").alias("n_symbols"),
    )
    once = F.size(F.array_distinct("_h")) == F.size("_h")
    step = step.select(
        "_row",
        "n_words",
        (F.col("_n") - F.col("_space")).alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.when(once, F.lit(0).cast("bigint")).otherwise(_repeat_words(F.col("_h"))).alias("n_repeat_words"),
        "_n",
        "_wide",
        *[f"_{name}" for name in CLASSES],
        bind(F.col("_c"), lambda c: F.transform(F.array(*[F.lit(w) for w in LISTED]), lambda w: F.size(F.filter(c, lambda x: x == w)))).alias("_common"),
    )
    def share(count: Column, space: bool = False) -> Column:
        among = F.lit(PROSE["space"]) if space else count / (F.col("_n") - F.col("_space")) * F.lit(1 - PROSE["space"])
        return F.when(F.col("_wide"), among).otherwise(count / F.col("_n"))

    shares = [share(F.col(f"_{name}"), name == "space") for name in CLASSES]
    rest = share(F.col("_n") - sum((F.col(f"_{name}") for name in CLASSES), F.lit(0)))
    char_distance = F.when(F.col("_n") >= JUDGED_CHARS, divergence([*shares, rest], list(PROSE.values()))).otherwise(0.0)

    def to(language: dict[str, float]) -> Column:
        counts = [F.get("_common", F.lit(LISTED.index(w))) for w in language]
        p = [n / F.col("n_words") for n in counts]
        others = (F.col("n_words") - sum(counts, F.lit(0))) / F.col("n_words")
        return divergence([*p, others], [*language.values(), 1 - sum(language.values())])

    def absent(language: dict[str, float]) -> Column:
        counts = [F.get("_common", F.lit(LISTED.index(w))) for w in language]
        hits = sum(counts, F.lit(0))
        forms = sum(((n > 0).cast("int") for n in counts), F.lit(0))
        lone = (forms < LISTED_FORMS) & (LONE_SHARE * hits < F.col("n_words"))
        return (LISTED_SHARE * hits < F.col("n_words")) | lone

    unlisted = SYMBOL_SHARE * F.col("_symbol") < F.col("n_words")
    for language in COMMON.values():
        unlisted = unlisted & absent(language)
    nearest = F.least(*[to(language) for language in COMMON.values()])
    word_distance = F.when(F.col("n_words") >= JUDGED_WORDS, nearest).otherwise(0.0)
    step = step.withColumns({"char_distance": char_distance, "word_distance": word_distance})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    close = (F.col("char_distance") <= MAX_CHAR_DISTANCE) & ((F.col("word_distance") <= MAX_WORD_DISTANCE) | unlisted)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance"]
    verdict = F.struct(*counts, failed.alias("base_failed"), (~failed & close).alias("kept"))
    return step.select(*[F.col("_row").getField(c).alias(c) for c in names], verdict.alias(name))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` with counts, distances and verdicts."""
    return measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "_q.*")


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass.

    The row number keeps the optimizer from moving the filter below the
    measuring steps, where every count would be computed once per use.
    """
    verdict, at = free_name("_q", docs), free_name("_at", docs)
    judged = measured(docs, text_col, verdict).withColumn(at, F.monotonically_increasing_id())
    return judged.filter(F.col(verdict)["kept"] & (F.col(at) >= 0)).drop(verdict, at)
