"""Windows of ``length`` symbols that also start earlier in the corpus.

Sampled places stand for all windows: the anchor of a window is the place of its
smallest ``k``-gram hash, so equal windows have equal anchors at equal offsets,
and neighbouring windows share one. Four steps, all keyed shuffles:

1. count anchors; one that occurs once cannot lie in a repeated window,
2. send the others back to their documents,
3. ship the stretch of each repeated anchor (all windows it stands for), sorted
   by anchor, document and place, and compare whole windows exactly,
4. gather the runs of repeated windows per document.

Hot anchors: a task flags at once what it has itself shipped from an earlier
place, so a passage leaves a task about once however many documents hold it; and
the windows of an anchor with more than ``HOT`` places are shipped one by one and
dealt by their own hash, so that no group is larger than that for different
windows.

Documents are told apart by id and text hash; rows with a null id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, pieces_of, written

HOT = 5000
_SLICE = 1 << 16
_SEEN = 400_000


@dataclass(frozen=True)
class Windows:
    """How texts become windows.

    ``symbols``: texts -> their 64-bit symbols in one array, and where each text
    begins in it (with the end); ``hashes``: symbols, k -> hash of every k
    neighbours; ``within``: whether an earlier place in the same document counts.
    ``units(text)`` is what ``stretch(units, first, count)`` takes the bytes from that
    are shipped for ``count`` neighbouring windows; ``keys(stretch)`` are the windows
    in it, whole, so that hashes find them but never decide.
    """

    length: int
    k: int
    within: bool
    symbols: Callable
    hashes: Callable
    units: Callable
    stretch: Callable
    keys: Callable


_PLACE = np.uint64((1 << 20) - 1)


def smallest(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value (by its upper 44 bits) in every
    ``width`` neighbours of at most 2**20 values: value and place in one number."""
    v, span = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), 1
    while span < width:
        step = min(span, width - span)
        v = np.minimum(v[:-step], v[step:])
        span += step
    return (v & _PLACE).astype(np.int64)


def anchors(a: np.ndarray, offsets: np.ndarray, spec: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of the symbols of several texts: its start, and the hash and
    place of each anchor, its first window and number of windows (all places
    absolute). Windows that cross the end of their text are left out."""
    edges = offsets[1:-1]
    for start in range(0, max(len(a) - spec.length + 1, 0), _SLICE):
        part = a[start : start + _SLICE + spec.length - 1]
        g = spec.hashes(part, spec.k)
        at = smallest(g, spec.length - spec.k + 1)
        near = edges[np.searchsorted(edges, start, "right") : np.searchsorted(edges, start + len(part), "left")] - start
        change = np.zeros(len(at) + 1, np.int32)
        np.add.at(change, np.clip(near - spec.length + 1, 0, len(at)), 1)
        np.add.at(change, np.clip(near, 0, len(at)), -1)
        inside = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        if not len(inside):
            continue
        at = at[inside]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        yield start, g[at[first]], at[first] + start, inside[first] + start, np.diff(np.r_[first, len(at)])


def _rows(spec: Windows, places: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, 2, 1 << 20):
                a, offsets = spec.symbols(batch.column(2).to_pylist())
                for _, found, place, _, _ in anchors(a, offsets, spec):
                    row = np.searchsorted(offsets, place, "right") - 1
                    out = {"anchor": pa.array(found.view(np.int64)), "doc": batch.column(0).take(pa.array(row))}
                    if places:
                        out |= {"tag": batch.column(1).take(pa.array(row)), "pos": pa.array(place - offsets[row])}
                    yield pa.RecordBatch.from_pydict(out)

    return run


def _known(seeds: pa.ListArray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Absolute places of the repeated anchors of a batch, sorted, and their counts."""
    ends = seeds.offsets.to_numpy()
    flat = seeds.values.slice(ends[0], ends[-1] - ends[0])
    place = flat.field("pos").to_numpy() + np.repeat(offsets[:-1], np.diff(ends))
    order = np.argsort(place)
    return place[order], flat.field("n").to_numpy()[order]


def _shipped(spec: Windows) -> Callable:
    """Rows ``doc, tag, text, seeds`` -> stretches to compare, and (``salt`` -1)
    runs of windows flagged on the spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}

        def earlier(key, doc: int, at: int) -> bool:
            held = seen.get(key)
            if held is not None and (held[0] < doc or (spec.within and held < (doc, at))):
                return True
            if held is None or (doc, at) < held:
                if len(seen) > _SEEN:
                    seen.clear()
                seen[key] = (doc, at)
            return False

        for whole in batches:
            for batch in pieces_of(whole, 2, 1 << 20):
                docs, tags, texts = (batch.column(c).to_pylist() for c in range(3))
                a, offsets = spec.symbols(texts)
                texts = [spec.units(t) for t in texts]
                known, times = _known(batch.column(3), offsets)
                for start, found, place, first, count in anchors(a, offsets, spec):
                    near = np.minimum(np.searchsorted(known, place), len(known) - 1)
                    hit = np.flatnonzero(known[near] == place)
                    n = times[near[hit]]
                    windows = None
                    if (n > HOT).any():
                        windows = spec.hashes(a[start : start + _SLICE + spec.length - 1], spec.length)
                    row = np.searchsorted(offsets, place[hit], "right") - 1
                    rows: list[tuple] = []
                    columns = found[hit].view(np.int64), row, offsets[row], first[hit], count[hit], n
                    for anchor, i, base, s, c, often in zip(*(x.tolist() for x in columns)):
                        doc, tag, text, at = docs[i], tags[i], texts[i], s - start
                        s -= base
                        if often <= HOT:
                            payload = spec.stretch(text, s, c)
                            if earlier(payload, doc, s):
                                rows.append((doc, -1, doc, tag, s, c, b""))
                            else:
                                rows.append((anchor, 0, doc, tag, s, c, payload))
                            continue
                        salts = -(-often // HOT)
                        for j, w in enumerate(windows[at : at + c].tolist()):
                            payload = spec.stretch(text, s + j, 1)
                            if earlier(payload, doc, s + j):
                                rows.append((doc, -1, doc, tag, s + j, 1, b""))
                            else:
                                rows.append((anchor, 1 + w % salts, doc, tag, s + j, 1, payload))
                    yield _batch(rows)

    return run


_KINDS = [("anchor", pa.int64()), ("salt", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("count", pa.int32()), ("payload", pa.binary())]
_SHIPPED = "anchor bigint, salt bigint, doc bigint, tag bigint, start bigint, count int, payload binary"
_RUNS = "doc bigint, tag bigint, lo bigint, hi bigint"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _KINDS)], names=[n for n, _ in _KINDS])


def _compare(spec: Windows) -> Callable:
    """Sorted stretches -> runs of window starts that also start earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, {}
        for batch in batches:
            out: list[tuple] = []
            for anchor, salt, doc, tag, start, count, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if salt < 0:
                    out.append((doc, tag, start, start + count))
                    continue
                if (anchor, salt) != group:
                    group, first = (anchor, salt), {}
                open_ = -1
                for j, key in enumerate(spec.keys(payload)):
                    here = (doc, start + j) if spec.within else doc
                    if first.setdefault(key, here) < here:
                        if open_ < 0:
                            open_ = j
                    elif open_ >= 0:
                        out.append((doc, tag, start + open_, start + j))
                        open_ = -1
                if open_ >= 0:
                    out.append((doc, tag, start + open_, start + count))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "tag", "lo", "hi"])

    return run


def runs(texts: DataFrame, spec: Windows) -> DataFrame:
    """``doc, tag, runs`` (array of ``lo, hi``: window starts lo..hi-1 also start
    earlier) from rows ``doc, tag, text``; documents without runs are absent."""
    given = texts.filter("doc is not null and text is not null")
    many = F.count("*") > 1 if spec.within else F.min("doc") < F.max("doc")
    counted = given.mapInArrow(_rows(spec, False), "anchor bigint, doc bigint").groupBy("anchor").agg(F.count("*").alias("n"), many.alias("many"))
    repeated = written(counted.filter("many").select("anchor", "n"), "anchors")
    # rows that repeat an id and a text have the same places: the set stays one document's
    places = given.mapInArrow(_rows(spec, True), "anchor bigint, doc bigint, tag bigint, pos bigint").join(repeated, "anchor")
    seeds = written(places.groupBy("doc", "tag").agg(F.collect_set(F.struct("pos", "n")).alias("seeds")), "seeds")
    shipped = given.join(seeds, ["doc", "tag"]).select("doc", "tag", "text", "seeds").mapInArrow(_shipped(spec), _SHIPPED)
    placed = shipped.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc", "start")
    flagged = placed.mapInArrow(_compare(spec), _RUNS)
    found = written(flagged.groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "runs")
    discard(repeated, seeds)
    return found


def covered(n: int, runs: list[dict] | None, length: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window of the runs."""
    change = np.zeros(n + 1, np.int32)
    for r in runs or ():
        change[r["lo"]] += 1
        change[min(n, r["hi"] + length - 1)] -= 1
    return np.cumsum(change[:n]) > 0
