"""k-means with all restarts in one pass over the data.

The vectors are packed once into blocks. Every pass measures each block against the
centres of all restarts that still move (one matrix product) and leaves per task a
few numbers per centre; these are added up in a tree, so what reaches the driver is
bounded by restarts, ``k`` and width, not by rows or tasks. A pass costs about the
same for one restart as for sixteen.

Starts come from k-means||: each round takes, per restart, ``2 k`` more vectors with
probability in proportion to the squared distance from those it has (weighted
sampling by keys, one pass a round); the candidates, weighted by the rows nearest to
them, are brought down to ``k`` on the driver. Draws are hashes of seed and vector,
so neither partitioning nor a retried task changes them; copies of a vector share
one draw.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_ROWS = 4096
_TASK_BYTES = 4 << 20  # a task with less than this costs more to start than to run
_DIRECT = 16  # so many partial results go to the driver unmerged
_FAN = 16  # partial results that a task merges


@dataclass(frozen=True)
class Centres:
    """A fitted model: ``k`` centres and the sum of squared distances to them."""

    points: np.ndarray
    cost: float = math.nan

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(x) for x in p], float(self.cost)) for i, p in enumerate(self.points)]
        spark.createDataFrame(rows, "cluster int, centre array<double>, cost double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Centres:
        rows = spark.read.parquet(path).orderBy("cluster").collect()  # k rows
        return cls(np.array([r["centre"] for r in rows]), rows[0]["cost"])


def pack(vectors: DataFrame, column: str) -> DataFrame:
    """``rows, data``: up to 4096 vectors as one row of doubles. Null vectors drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_pylist()
            for i in range(0, len(held), _ROWS):
                part = np.array(held[i : i + _ROWS], np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["rows", "data"])

    given = vectors.select(F.col(column).cast("array<double>").alias("v")).filter("v is not null")
    return given.mapInArrow(run, "rows bigint, data binary")


def reduced(blocks: DataFrame, work: Callable, merge: Callable):
    """``work`` over the blocks of each task, the results merged in a tree."""

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield np.frombuffer(data).reshape(n, -1)

    def row(value) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], names=["part"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in blocks_of(batches):
            own = work(x)
            total = own if total is None else merge(total, own)
        if total is not None:
            yield row(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(0).to_pylist():
                own = pickle.loads(part)
                total = own if total is None else merge(total, own)
        if total is not None:
            yield row(total)

    parts = blocks.mapInArrow(first, "part binary")
    tasks = blocks.rdd.getNumPartitions()
    while tasks > _DIRECT:
        tasks = math.ceil(tasks / _FAN)
        parts = parts.repartition(tasks).mapInArrow(again, "part binary")
    total = None
    for r in parts.collect():  # at most _DIRECT rows
        own = pickle.loads(r["part"])
        total = own if total is None else merge(total, own)
    return total


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to ``restart x k`` centres: rows, restart, k."""
    flat = centres.reshape(-1, centres.shape[-1])
    d = (x * x).sum(1)[:, None] - 2 * (x @ flat.T) + (flat * flat).sum(1)
    return np.maximum(d, 0).reshape(len(x), *centres.shape[:-1])


def measure(blocks: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per restart and centre the number, and the sum, of the rows nearest to it
    (the first of equals), and per restart the cost."""
    restarts, k, _ = centres.shape

    def work(x: np.ndarray) -> tuple:
        d = distances(x, centres)
        near = d.argmin(2)
        own = np.zeros((restarts * k, len(x)))
        own[(near + np.arange(restarts) * k).T.ravel(), np.tile(np.arange(len(x)), restarts)] = 1
        cost = np.take_along_axis(d, near[:, :, None], 2).sum((0, 2))
        return own.sum(1).reshape(restarts, k), (own @ x).reshape(centres.shape), cost

    return reduced(blocks, work, lambda a, b: tuple(p + q for p, q in zip(a, b)))


def lloyd(blocks: DataFrame, starts: np.ndarray, max_iter: int = 300, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, numbers of rows and costs after up to ``max_iter`` rounds from given
    starts (``restart x k x width``). A restart whose centres move no further than
    ``tol`` takes no part any more; a centre without rows stays where it is."""
    centres = starts.astype(np.float64).copy()
    open_ = np.arange(len(centres))
    for _ in range(max_iter):
        counts, sums, _ = measure(blocks, centres[open_])
        moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres[open_])
        far = np.sqrt(((moved - centres[open_]) ** 2).sum(2)).max(1) > tol
        centres[open_] = moved
        open_ = open_[far]
        if not len(open_):
            break
    counts, _, costs = measure(blocks, centres)
    return centres, counts, costs


def _uniform(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A number in (0, 1) per row and seed, from the row's bits."""
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
    factors = np.multiply.accumulate(np.full(x.shape[1], a))
    h = ((x + 0.0).view(np.uint64) * factors).sum(1, dtype=np.uint64)
    h = h[:, None] ^ (seeds.astype(np.uint64) * b + a)
    for shift in (32, 29, 32):
        h = (h ^ (h >> np.uint64(shift))) * b
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _drawn(blocks: DataFrame, held: list[np.ndarray], most: int, seeds: np.ndarray) -> list[np.ndarray]:
    """Per restart up to ``most`` different rows, drawn in proportion to the squared
    distance from those it holds (all alike if it holds none)."""

    def work(x: np.ndarray) -> list:
        out, u = [], _uniform(x, seeds)
        for r, own in enumerate(held):
            weight = distances(x, own[None])[:, 0].min(1) if len(own) else np.ones(len(x))
            key = np.log(u[:, r]) / np.maximum(weight, 1e-300)
            best = np.argsort(-np.where(weight > 1e-12, key, -np.inf), kind="stable")[: 4 * most]
            best = best[weight[best] > 1e-12]
            out.append((key[best], x[best]))
        return merge(out, None)

    def merge(a: list, b: list | None) -> list:
        out = []
        for r in range(len(held)):
            key, rows = a[r] if b is None else (np.r_[a[r][0], b[r][0]], np.r_[a[r][1], b[r][1]])
            _, once = np.unique(rows, axis=0, return_index=True)  # copies share a key
            best = once[np.argsort(-key[once], kind="stable")][:most]
            out.append((key[best], rows[best]))
        return out

    found = reduced(blocks, work, merge)
    return [rows for _, rows in found]


def _brought_down(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` of some weighted points: k-means++ and a few rounds over them."""
    weights = np.maximum(weights, 1e-9)
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    while len(chosen) < k:
        d = distances(points, np.array(chosen)[None])[:, 0].min(1) * weights
        if d.sum() <= 0:  # fewer different points than centres
            chosen.append(points[len(chosen) % len(points)])
        else:
            chosen.append(points[rng.choice(len(points), p=d / d.sum())])
    centres = np.array(chosen)
    for _ in range(30):
        near = distances(points, centres[None])[:, 0].argmin(1)
        for c in range(k):
            own = near == c
            if own.any():
                centres[c] = np.average(points[own], axis=0, weights=weights[own])
    return centres


def starts(blocks: DataFrame, k: int, n_init: int, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """``n_init x k x width`` starting centres by k-means||."""
    seeds = np.arange(seed, seed + n_init)
    held = _drawn(blocks, [np.zeros((0, 0))] * n_init, 1, seeds * 1000)
    for step in range(1, rounds + 1):
        more = _drawn(blocks, held, 2 * k, seeds * 1000 + step)
        held = [np.vstack([a, b]) if len(b) else a for a, b in zip(held, more)]
    most = max(len(h) for h in held)  # 1 + 2 k rounds at most
    padded = np.stack([np.vstack([h, np.repeat(h[:1], most - len(h), 0)]) for h in held])
    counts, _, _ = measure(blocks, padded)
    return np.stack([_brought_down(p, n, k, np.random.default_rng(int(s))) for p, n, s in zip(padded, counts, seeds)])


def fit_kmeans(vectors: DataFrame, column: str, k: int = 10, n_init: int = 1, max_iter: int = 300, init_steps: int = 2, seed: int = 0, tol: float = 1e-4) -> Centres:
    """Of ``n_init`` restarts the one with the least cost; ties take the first.
    An empty table is an error."""
    packed = pack(vectors, column).persist()
    try:
        size = packed.agg(F.sum(F.octet_length("data"))).first()[0]
        if not size:
            raise ValueError("k-means needs at least one vector")
        blocks = packed.coalesce(min(packed.rdd.getNumPartitions(), math.ceil(size / _TASK_BYTES)))
        centres, _, costs = lloyd(blocks, starts(blocks, k, n_init, init_steps, seed), max_iter, tol)
    finally:
        packed.unpersist()
    best = int(costs.argmin())
    return Centres(centres[best], float(costs[best]))


def assign(vectors: DataFrame, column: str, model: Centres) -> DataFrame:
    """Adds ``cluster``, the nearest centre (null for a null vector); every other
    column, the key included, travels along."""
    points = model.points[None]

    @F.pandas_udf(T.IntegerType())
    def nearest(v: pd.Series) -> pd.Series:
        known = v.notna()
        out = pd.Series([None] * len(v), dtype="object")
        if known.any():
            out[known.to_numpy()] = distances(np.array(v[known].tolist(), np.float64), points)[:, 0].argmin(1)
        return out.astype("Int32")

    return vectors.withColumn("cluster", nearest(F.col(column).cast("array<double>")))
