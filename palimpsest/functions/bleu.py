"""Sentence BLEU as one native expression over token arrays, and an Arrow helper
that compares a text with several others."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .collections import bind, index_range, numbered_copies

MAX_ORDER = 4


def ngrams(tokens: Column, n: int) -> Column:
    """Space-free n-grams of a token array, joined by a control character."""
    if n == 1:
        return tokens
    return F.transform(
        index_range(F.size(tokens) - (n - 1)),
        lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), "\u0001"),
    )


def combine(matches: list[Column], totals: list[Column], ref_len: Column, hyp_len: Column) -> Column:
    """BLEU from clipped matches and n-gram totals.

    The k-th order without a match gets precision ``1 / (2**k * total)``; no
    unigram match or an empty hypothesis gives 0.
    """
    empty_before = F.lit(0)
    log_sum = F.lit(0.0)
    for hit, total in zip(matches, totals):
        floor_total = F.greatest(total, F.lit(1)).cast("double")
        miss = hit == 0
        empty_before = empty_before + F.when(miss, 1).otherwise(0)
        precision = F.when(
            miss, 1.0 / (F.pow(F.lit(2.0), empty_before.cast("double")) * floor_total)
        ).otherwise(hit.cast("double") / floor_total)
        log_sum = log_sum + F.log(precision) / MAX_ORDER
    penalty = F.when(hyp_len > ref_len, F.lit(1.0)).otherwise(
        F.exp(1.0 - ref_len.cast("double") / F.greatest(hyp_len, F.lit(1)).cast("double"))
    )
    return F.when((hyp_len == 0) | (matches[0] == 0), F.lit(0.0)).otherwise(
        penalty * F.exp(log_sum)
    )


def profile(tokens: Column) -> Column:
    """Everything BLEU needs of one text: its length and, per order, its n-grams
    tagged with occurrence numbers."""
    return bind(
        tokens,
        lambda t: F.struct(
            F.size(t).alias("len"),
            *[numbered_copies(ngrams(t, n)).alias(f"g{n}") for n in range(1, MAX_ORDER + 1)],
        ),
    )


def bleu_of_profiles(ref: Column, hyp: Column) -> Column:
    orders = range(1, MAX_ORDER + 1)
    matches = F.struct(
        *[F.size(F.array_intersect(ref[f"g{n}"], hyp[f"g{n}"])).alias(f"m{n}") for n in orders]
    )
    return bind(
        matches,
        lambda m: combine(
            [m[f"m{n}"] for n in orders], [hyp["len"] - (n - 1) for n in orders], ref["len"], hyp["len"]
        ),
    )


def lengths_allow(ref_len: Column, hyp_len: Column, threshold: float) -> Column:
    """Whether BLEU of texts of these lengths can exceed ``threshold``.

    The brevity penalty bounds the score, and a text of ``hyp_len`` words shares at
    most ``ref_len`` of them.
    """
    r, h = ref_len.cast("double"), hyp_len.cast("double")
    penalty = F.least(F.exp(1.0 - r / h), F.lit(1.0))
    words = F.pow(F.least(r / h, F.lit(1.0)), F.lit(1.0 / MAX_ORDER))
    return F.when((h > 0) & (r > 0), penalty * words > threshold - 1e-9).otherwise(F.lit(False))


def _counts(text: str, n: int) -> Counter:
    tokens = text.split(" ")
    return Counter(zip(*(tokens[i:] for i in range(n))))


def text_bleu_above(ref: str, hyp: str, threshold: float, counts=_counts) -> bool:
    """``bleu > threshold`` for two texts of tokens joined by spaces, by the rule of
    ``combine``; orders are counted until what is left cannot reach the threshold."""
    r, h = ref.count(" ") + 1, hyp.count(" ") + 1
    penalty = 1.0 if h > r else math.exp(1.0 - r / h)
    log_sum, empty = 0.0, 0
    for n in range(1, MAX_ORDER + 1):
        theirs = counts(ref, n)
        hit = sum(min(c, theirs[g]) for g, c in counts(hyp, n).items() if g in theirs)
        total = max(h - n + 1, 1)
        if n == 1 and not hit:
            return False
        empty += not hit
        log_sum += math.log(hit / total if hit else 1.0 / (2.0**empty * total)) / MAX_ORDER
        if penalty * math.exp(log_sum) <= threshold - 1e-9:
            return False
    return penalty * math.exp(log_sum) > threshold


def any_above(thresholds: list[float]):
    """UDF: whether some candidate reaches every threshold, one per kind of text.

    Takes per kind the own text (the hypothesis) and the candidates' texts (the
    references), tokens joined by spaces, none of them empty.
    """

    @F.pandas_udf(T.BooleanType())
    def run(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        counts = lru_cache(maxsize=64)(_counts)  # rows next to each other share their texts
        for batch in columns:
            own, others = batch[::2], batch[1::2]
            yield pd.Series(
                [
                    any(all(text_bleu_above(r, h, x, counts) for r, h, x in zip(refs, texts, thresholds)) for refs in zip(*found))
                    for texts, found in zip(zip(*own), zip(*others))
                ],
                dtype=bool,
            )

    return run.asNondeterministic()


def bleu(ref: Column, hyp: Column) -> Column:
    """BLEU of one hypothesis against one reference (token arrays)."""
    return bind(
        F.struct(profile(ref).alias("r"), profile(hyp).alias("h")),
        lambda p: bleu_of_profiles(p["r"], p["h"]),
    )
