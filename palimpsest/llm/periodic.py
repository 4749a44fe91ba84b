"""Periodic runs of words by maximal pairs of an LCP-interval tree.

A run is a stretch of words with smallest period ``q`` that is at least
``max(LEAST, 2 * q)`` long and that no neighbouring word extends. Two places
``i < j`` whose following ``l`` words agree, while the words before and after
them differ, are a maximal pair; with ``q = j - i <= l`` the stretch from ``i`` to
``j + l`` is a maximal stretch of period ``q``. So the maximal pairs of bounded
distance are the runs, nothing is extended afterwards; the multiples of a period
give the same stretch again and the smallest one stays.

Per document, inside one task:

1. a hash of every ``LEAST // 2`` neighbouring words tells which documents repeat
   any; the others have no run (a pair needs ``l >= LEAST / 2``),
2. suffix array and common prefixes by rank doubling over exact word numbers,
3. the LCP-interval tree bottom-up. A node holds its places in order and one list
   of places per left word; the smaller child looks up its places in the larger
   one, within the distance only, and jumps over stretches of its own left word.

Documents do not meet, so there is no shuffle. Memory is about 200 bytes per word
of the longest document.

Defined results: null and empty texts and texts without a run have an empty list
of runs, and ``collapsed`` is their words; rows that repeat are answered one by
one; null ids are kept; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MIX_A, grams, mix, pieces_of

LEAST = 12
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a sequence, and the common prefix of neighbours."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels, k = [rank], 1
    while k < n and rank.max() < n - 1:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        k *= 2
    order = np.argsort(rank)
    i, j, common = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = i + common, j + common
        inside = np.flatnonzero(np.maximum(x, y) < n)
        same = inside[levels[t][x[inside]] == levels[t][y[inside]]]
        common[same] += 1 << t
    return order, common


class Places:
    """Places of a tree node: all in order, and in order per left word."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int):
        self.all = [place]
        self.by_left = {left: [place]}

    def others(self, lo: int, hi: int, left: int, lefts: list[int]) -> Iterator[int]:
        """Places from ``lo`` to ``hi`` that have another left word."""
        places = self.all
        t, end = bisect_left(places, lo), len(places)
        while t < end and places[t] <= hi:
            if lefts[places[t]] != left:
                yield places[t]
                t += 1
                continue
            own = self.by_left[left]
            k = bisect_left(own, places[t])
            most = min(len(own) - k, end - t)
            good, step = 1, 1  # places t .. t + good - 1 all have this left word
            while good + step <= most and own[k + good + step - 1] == places[t + good + step - 1]:
                good += step
                step *= 2
            while step:
                if good + step <= most and own[k + good + step - 1] == places[t + good + step - 1]:
                    good += step
                step //= 2
            t += good

    def take(self, small: Places) -> None:
        self.all = merged(self.all, small.all)
        for left, own in small.by_left.items():
            held = self.by_left.get(left)
            self.by_left[left] = own if held is None else merged(held, own)


def merged(large: list[int], small: list[int]) -> list[int]:
    if len(small) * 16 > len(large):
        return sorted(large + small)
    for place in small:
        insort(large, place)
    return large


def maximal_pairs(codes: np.ndarray, shortest: int) -> Iterator[tuple[int, int, int]]:
    """``(i, j, l)``: maximal pairs ``i < j`` of common length ``l >= shortest``
    that are at most ``l`` apart."""
    order, common = suffix_array(codes)
    lefts = [-1, *codes[:-1].tolist()]
    stack: list[list] = []  # open intervals: common length, places so far

    def joined(a: Places, b: Places, length: int) -> Places:
        if len(a.all) < len(b.all):
            a, b = b, a
        for p in b.all:
            for q in a.others(p - length, p + length, lefts[p], lefts):
                found.append((p, q, length) if p < q else (q, p, length))
        a.take(b)
        return a

    found: list[tuple[int, int, int]] = []
    suffixes = order.tolist()
    now = None  # the finished subtree on the left of the next boundary
    for k, length in enumerate([*common.tolist(), 0]):
        if now is None:
            if length < shortest:
                continue
            now = Places(suffixes[k], lefts[suffixes[k]])
        while stack and stack[-1][0] > length:
            high, held = stack.pop()
            now = joined(held, now, high)
        if length < shortest:
            now = None
        else:
            if stack and stack[-1][0] == length:
                stack[-1][1] = joined(stack[-1][1], now, length)
            else:
                stack.append([length, now])
            now = Places(suffixes[k + 1], lefts[suffixes[k + 1]])
        yield from found
        found.clear()


def runs_of(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of a sequence, by start and period."""
    best: dict[tuple[int, int], int] = {}
    if len(codes) < least:
        return []
    for i, j, length in maximal_pairs(codes, -(-least // 2)):
        key = i, j - i + length
        if key[1] >= least and best.get(key, j) >= j - i:
            best[key] = j - i
    return sorted((start, length, period) for (start, length), period in best.items())


def repeating(codes: np.ndarray, sizes: list[int], k: int) -> np.ndarray:
    """Which of several sequences (concatenated) hold some ``k`` neighbours twice;
    by hash, so that it may name too many but misses none."""
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    h = grams(mix(codes.astype(np.uint64) * MIX_A + MIX_A), k)
    own = row[: len(h)]
    inside = np.flatnonzero(np.arange(len(h)) + k <= ends[own]) if len(h) else np.zeros(0, np.int64)
    own, h = own[inside], h[inside] ^ mix(own[inside].astype(np.uint64) * MIX_A)
    order = np.argsort(h)
    h, own = h[order], own[order]
    twice = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    return np.unique(own[1:][twice])


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs`` (array of ``start, length, period`` in words) ``, collapsed``:
    the words, one space between, without those a run holds after its first period."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, 1, 1 << 20):
                words = [(t or b"").split() for t in batch.column(1).to_pylist()]
                numbers: dict[bytes, int] = {}
                flat = [numbers.setdefault(w, len(numbers)) for own in words for w in own]
                codes, sizes = np.array(flat, np.int64), [len(w) for w in words]
                ends = np.cumsum(sizes).tolist()
                runs: list[list[tuple]] = [[] for _ in words]
                for row in repeating(codes, sizes, -(-least // 2)).tolist():
                    runs[row] = runs_of(codes[ends[row] - sizes[row] : ends[row]], least)
                    gone = np.zeros(sizes[row] + 1, np.int32)
                    for start, length, period in runs[row]:
                        gone[start + period] += 1
                        gone[start + length] -= 1
                    mask = (np.cumsum(gone[:-1]) > 0).tolist()
                    words[row] = [w for w, m in zip(words[row], mask) if not m]
                listed = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(listed, pa.list_(RUN)), pa.array([b" ".join(w) for w in words], pa.binary())],
                    names=["doc_id", "runs", "collapsed"],
                )

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(find, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary")
