"""k-means with restarts, and exact density clustering by cosine distance."""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.collections import argmax, bind, bound, dot
from ..session import cut_lineage, scratch_path
from .kmeans import Centres, assign, fit_kmeans
from .ordering import group_rank, with_index

__all__ = [
    "Centres", "assign", "fit_kmeans", "nearest_centroid", "gate_route", "collapse_copies",
    "pack_blocks", "candidate_pairs", "eps_pairs", "components", "dbscan",
]


# ---- k-means -------------------------------------------------------------------


@bound(2)
def nearest_centroid(vector: Column, centroids: Column) -> Column:
    """0-based index of the closest of a short array of centroids (first on a tie)."""
    distances = F.transform(
        centroids,
        lambda c: F.aggregate(
            F.zip_with(vector, c, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))),
            F.lit(0.0),
            lambda acc, x: acc + x,
        ),
    )
    return bind(distances, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int"))


@bound(2)
def gate_route(vector: Column, weights: Column, temperature: float = 1.0) -> Column:
    """Top-1 expert and its probability: ``struct<expert, prob>``."""
    from .records import softmax

    logits = F.transform(weights, lambda w: dot(vector, w))
    return bind(
        softmax(logits, temperature),
        lambda p: F.struct(argmax(p).cast("int").alias("expert"), F.array_max(p).alias("prob")),
    )


# ---- neighbour search ----------------------------------------------------------

BLOCK = 2048
_BLOCK_TYPE = "block bigint, ids array<bigint>, weights array<bigint>, vectors binary, centre array<double>, radius double, dim int"


def collapse_copies(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """One row per distinct vector: smallest id and number of copies.

    Copies are mutual neighbours at distance 0; a group of any size costs one
    row from here on.
    """
    return vectors.groupBy(column).agg(F.min(key).alias("id"), F.count("*").alias("weight"))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    given = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
    short = given.astype(np.float32)
    m = _unit(given)
    centre = m.mean(axis=0)
    length = np.linalg.norm(centre)
    centre = centre / length if length > 0 else m[0]
    radius = float(np.arccos(np.clip(m @ centre, -1, 1)).max())
    return pd.DataFrame(
        {
            "block": [int(pdf["block"].iloc[0])],
            "ids": [pdf["id"].to_numpy()],
            "weights": [pdf["weight"].to_numpy()],
            # as they were given, in half the bytes where that loses nothing
            "vectors": [(short if (short == given).all() else given).tobytes()],
            "centre": [centre],
            "radius": [radius],
            "dim": [m.shape[1]],
        }
    )


def pack_blocks(points: DataFrame, column: str, block: int = BLOCK, pivots: int | None = None) -> DataFrame:
    """Bounded blocks of vectors, near ones together.

    A point belongs to its nearest pivot; there it stands by its second nearest
    pivot, and the points of a pivot are cut into blocks of constant size in this
    order, so a dense region becomes many blocks instead of one big group and no
    block mixes pivots. The driver holds the pivots alone: by default their
    number is four times the root of the number of blocks needed (2,800 for a
    billion points). A block's number is its pivot's, shifted by 32 bits, plus
    its place there.
    """
    if pivots is None:
        pivots = math.ceil(4 * math.sqrt(points.count() / block)) or 1
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(pivots).select(column).collect()
    anchors = np.array([r[0] for r in chosen], dtype=np.float64)
    anchors /= np.maximum(np.linalg.norm(anchors, axis=-1, keepdims=True), 1e-300)

    @F.pandas_udf("pivot bigint, second bigint")
    def cell(v: pd.Series) -> pd.DataFrame:
        score = np.stack(v.to_numpy()) @ anchors.T
        first = score.argmax(axis=1)
        score[np.arange(len(score)), first] = -np.inf
        return pd.DataFrame({"pivot": first, "second": score.argmax(axis=1)})

    near = points.select("id", "weight", F.col(column).alias("v"), cell(F.col(column)).alias("_cell"))
    ranked = group_rank(near.select("id", "weight", "v", "_cell.*"), ["pivot"], ["second", "id"], "_rank")
    number = F.shiftleft("pivot", 32) + F.floor(F.col("_rank") / block).cast("bigint")
    cells = ranked.select("id", "weight", "v", number.alias("block"))
    return cut_lineage(cells.groupBy("block").applyInPandas(_pack, _BLOCK_TYPE))


def _ball(pdf: pd.DataFrame) -> pd.DataFrame:
    """One ball around the balls of a run of blocks."""
    centres = np.stack(pdf["centre"].to_numpy())
    centre = centres.mean(axis=0)
    length = np.linalg.norm(centre)
    centre = centre / length if length > 0 else centres[0]
    reach = np.arccos(np.clip(centres @ centre, -1, 1)) + pdf["radius"].to_numpy()
    return pd.DataFrame({"run": [pdf["run"].iloc[0]], "centre": [centre], "radius": [float(reach.max())]})


class _Side:
    """Columns of one aliased side of a join."""

    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.alias}.{name}")


def _reachable(left: _Side, right: _Side, eps: float) -> Column:
    """The angle between the centres less both radii does not exceed the search
    angle (triangle inequality on angles)."""
    limit = math.acos(max(-1.0, 1.0 - eps)) + 1e-6
    cosine = F.greatest(F.least(dot(left["centre"], right["centre"]), F.lit(1.0)), F.lit(-1.0))
    return F.acos(cosine) - left["radius"] - right["radius"] <= limit


def candidate_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """``a, b`` (``a <= b``): block pairs in reachable runs, not yet compared by
    their own balls.

    Neighbouring blocks of a pivot form a run with a ball around theirs, of no
    more blocks than the root of their number. Runs are thus
    about as many as that root and the pivots, and runs meeting runs make a few
    pairs per block; only blocks of reachable runs are paired at all.
    """
    step = F.greatest(F.ceil(F.sqrt(blocks.agg(F.count("*")).scalar())), F.lit(1))
    place = F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    run = F.struct(F.shiftright("block", 32).alias("pivot"), F.floor(place / step).cast("bigint").alias("chunk")).alias("run")
    heads = blocks.select("block", run, "centre", "radius")
    balls = heads.groupBy("run").applyInPandas(_ball, "run struct<pivot:bigint,chunk:bigint>, centre array<double>, radius double")
    runs = with_index(balls, ["run"], "number")
    last = runs.agg(F.max("number")).scalar()
    x = runs.select("run", "centre", "radius", "number", F.explode(F.sequence(F.col("number"), last)).alias("other")).alias("x")
    y = runs.select(F.col("run").alias("other_run"), "centre", "radius", F.col("number").alias("other_number")).alias("y")
    met = x.join(y, F.col("other") == F.col("other_number")).filter(
        (F.col("number") == F.col("other_number")) | _reachable(_Side("x"), _Side("y"), eps)
    )
    own = heads.select("run", F.col("block").alias("a"))
    theirs = heads.select(F.col("run").alias("other_run"), F.col("block").alias("b"))
    paired = met.select("run", "other_run").join(own, "run").join(theirs, "other_run")
    return paired.filter("run <> other_run or a <= b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """``a, b, tile`` (``a <= b``): block pairs whose balls may hold neighbours, and
    the tile they are compared in.

    Blocks in order are cut into groups, and a tile is what two groups have to
    compare, so that a block travels once per tile and not once per pair. Groups
    grow with the root of the number of blocks (half of it), up to ``TILE`` blocks.
    """
    x = blocks.select(F.col("block").alias("a"), "centre", "radius").alias("x")
    y = blocks.select(F.col("block").alias("b"), "centre", "radius").alias("y")
    meets = (F.col("a") == F.col("b")) | _reachable(_Side("x"), _Side("y"), eps)
    met = candidate_pairs(blocks, eps).join(x, "a").join(y, "b").filter(meets).select("a", "b")
    size = F.least(F.greatest(F.ceil(F.sqrt(blocks.agg(F.count("*")).scalar()) / 2), F.lit(1)), F.lit(TILE))
    groups = with_index(blocks.select("block"), ["block"], "number").select(
        "block", F.floor(F.col("number") / size).cast("bigint").alias("group")
    )
    left = groups.select(F.col("block").alias("a"), F.col("group").alias("_ga"))
    right = groups.select(F.col("block").alias("b"), F.col("group").alias("_gb"))
    return met.join(left, "a").join(right, "b").select("a", "b", F.struct("_ga", "_gb").alias("tile"))


TILE = 16


def _matrix(block) -> np.ndarray:
    """The unit vectors of a block."""
    raw, n = block["vectors"], len(block["ids"])
    kind = np.float32 if len(raw) == 4 * n * block["dim"] else np.float64
    return _unit(np.frombuffer(raw, kind).reshape(-1, block["dim"]))


def _per_block_pair(blocks: DataFrame, pairs: DataFrame, eps: float, work, schema: str) -> DataFrame:
    """``work`` on every pair of blocks, tile by tile: it gets the ids, weights and
    unit vectors of both sides and their matrix of hits."""
    sides = ["ids", "weights", "vectors", "dim"]
    needed = pairs.select("tile", F.explode(F.array("a", "b")).alias("block")).distinct()
    held = needed.join(blocks.select("block", *sides), "block").groupBy("tile").agg(
        F.collect_list(F.struct("block", *sides)).alias("blocks")
    )
    listed = pairs.groupBy("tile").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))

    def run(batches):
        for pdf in batches:
            for blocks_, pairs_ in zip(pdf["blocks"], pdf["pairs"]):
                own = {x["block"]: x for x in blocks_}
                units = {k: _matrix(x) for k, x in own.items()}
                for pair in pairs_:
                    a, b = pair["a"], pair["b"]
                    hit = 1.0 - units[a] @ units[b].T <= eps
                    if a == b:
                        np.fill_diagonal(hit, True)
                    row = SimpleNamespace(
                        a=a, b=b, a_ids=own[a]["ids"], b_ids=own[b]["ids"], a_weights=own[a]["weights"],
                        b_weights=own[b]["weights"], a_unit=units[a], b_unit=units[b],
                    )
                    out = work(row, hit)
                    if len(out):
                        yield out

    return held.join(listed, "tile").select("blocks", "pairs").mapInPandas(run, schema)


def eps_pairs(vectors: DataFrame, key: str, column: str, eps: float, block: int = BLOCK) -> DataFrame:
    """``a, b, distance`` of distinct vectors within cosine distance ``eps``.

    Copies stand behind their smallest id. The output is what is asked for, so
    its size is the number of such pairs; the density clustering below never
    builds it.
    """
    blocks = pack_blocks(cut_lineage(collapse_copies(vectors, key, column)), column, block)

    def found(row, hit):
        if row.a == row.b:
            hit = np.triu(hit, 1)
        i, j = np.nonzero(hit)
        x, y = row.a_unit, row.b_unit
        ia, ib = np.asarray(row.a_ids)[i], np.asarray(row.b_ids)[j]
        d = 1.0 - np.einsum("ij,ij->i", x[i], y[j])
        return pd.DataFrame({"a": np.minimum(ia, ib), "b": np.maximum(ia, ib), "distance": d})

    return _per_block_pair(blocks, block_pairs(blocks, eps), eps, found, "a bigint, b bigint, distance double")


def _neighbour_counts(blocks: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    def count(row, hit):
        wa, wb = np.asarray(row.a_weights), np.asarray(row.b_weights)
        left = pd.DataFrame({"id": row.a_ids, "n": hit @ wb})
        if row.a == row.b:
            return left
        return pd.concat([left, pd.DataFrame({"id": row.b_ids, "n": hit.T @ wa})])

    return _per_block_pair(blocks, pairs, eps, count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _forest(ids_a: np.ndarray, ids_b: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Edges with the same connected components as a bipartite hit matrix, at
    most one per point: every component is tied to its smallest member."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, row in zip(ids_a, hit):
        for j in ids_b[row]:
            x, y = find(int(i)), find(int(j))
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in parent if find(x) != x]


def _core_edges(blocks: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """Spanning edges between core points: per block pair at most one edge per
    point, however many neighbours it has. ``weights`` flags core points here."""

    def edges(row, hit):
        ca, cb = np.asarray(row.a_weights) > 0, np.asarray(row.b_weights) > 0
        found = _forest(np.asarray(row.a_ids)[ca], np.asarray(row.b_ids)[cb], hit[np.ix_(ca, cb)])
        return pd.DataFrame(found, columns=["src", "dst"])

    return _per_block_pair(blocks, pairs, eps, edges, "src bigint, dst bigint")


def _border_links(blocks: DataFrame, pairs: DataFrame, eps: float) -> DataFrame:
    """``id, label``: the smallest cluster among the core neighbours of a point
    that is not core. ``weights`` holds a core point's label + 1, else 0."""

    def side(ids, own, other, hit):
        plain = np.asarray(own) == 0
        core = np.asarray(other)
        masked = np.where(hit[plain] & (core > 0), core, np.iinfo(np.int64).max)
        best = masked.min(axis=1) if masked.shape[1] else np.full(plain.sum(), np.iinfo(np.int64).max)
        ok = best < np.iinfo(np.int64).max
        return pd.DataFrame({"id": np.asarray(ids)[plain][ok], "label": best[ok] - 1})

    def links(row, hit):
        left = side(row.a_ids, row.a_weights, row.b_weights, hit)
        if row.a == row.b:
            return left
        return pd.concat([left, side(row.b_ids, row.b_weights, row.a_weights, hit.T)])

    return _per_block_pair(blocks, pairs, eps, links, "id bigint, label bigint").groupBy("id").agg(F.min("label").alias("label"))


def _with_flags(blocks: DataFrame, flags: DataFrame) -> DataFrame:
    """Blocks whose ``weights`` are replaced by a per-point number (default 0)."""
    points = blocks.select("block", F.posexplode("ids").alias("_pos", "id"))
    per_block = (
        points.join(flags, "id", "left")
        .groupBy("block")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("flag", F.lit(0)).cast("bigint").alias("f")))),
                lambda x: x["f"],
            ).alias("weights")
        )
    )
    return blocks.drop("weights").join(per_block, "block")


def _shrink(batches):
    """Links of one task with the same components, one per node at most: every
    node is tied to the smallest it is linked with here. Every ``_HELD`` nodes
    the forest goes out and a new one starts."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def forest() -> pa.RecordBatch:
        links = [(x, find(x)) for x in parent]
        links = [(x, top) for x, top in links if x != top]
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"]
        )

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > _HELD:
            yield forest()
            parent.clear()
    yield forest()


_HELD = 500_000


def _stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "components")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` with the smallest id of each connected component.

    The graph is contracted until no link is left. Each round shrinks the links
    to forests inside the tasks, gives every node the one among itself and its
    neighbours whose hash (another one each round) is smallest, and joins the
    links with that choice; a node stays only while another chose it, so on
    average a fixed share of the nodes goes each round, for chains and stars
    alike. The choices are then followed back from the last round to the first,
    and the smallest id per remaining node names the component. A node with a
    third of all links is one row of the choices: its links are combined before
    the shuffle when choosing, and split by adaptive execution when joined. Every
    round is a written table: a checkpoint would keep the estimated size, which
    multiplies with each join, where a file's size is true.
    """
    given = _stored(edges.select(F.col("src").cast("bigint").alias("a"), F.col("dst").cast("bigint").alias("b")))
    nodes = given.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = given.filter("a <> b")
    choices = []
    while True:
        forest = _stored(links.mapInArrow(_shrink, "a bigint, b bigint").distinct())
        if forest.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(choices))), F.col(c).alias("node"))
        both = forest.union(forest.select("b", "a"))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("_near"))
        chosen = _stored(best.select(F.col("a").alias("node"), F.least("_near", rank("a"))["node"].alias("rep")))
        choices.append(chosen)
        x = chosen.select(F.col("node").alias("a"), F.col("rep").alias("x"))
        y = chosen.select(F.col("node").alias("b"), F.col("rep").alias("y"))
        links = forest.join(x, "a").join(y, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not choices:
        return nodes.select("id", F.col("id").alias("label"))
    tops = choices.pop()
    while choices:
        upper = tops.select(F.col("node").alias("rep"), F.col("rep").alias("_top"))
        lower = choices.pop()
        tops = _stored(lower.join(upper, "rep", "left").select("node", F.coalesce("_top", "rep").alias("rep")))
    smallest = tops.groupBy("rep").agg(F.least(F.min("node"), F.col("rep")).alias("label"))
    named = tops.join(smallest, "rep").select(F.col("node").alias("id"), "label")
    return nodes.join(named, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def dbscan(
    vectors: DataFrame, key: str, column: str, eps: float = 0.5, min_samples: int = 5, block: int = BLOCK
) -> DataFrame:
    """``key, cluster``: smallest core id of the cluster, or -1 for noise.

    A point is core with at least ``min_samples`` neighbours within ``eps``
    (copies and itself count); a border point joins the neighbouring cluster
    with the smallest label. Three passes over one table of pruned block pairs produce
    counts, spanning edges and border links, each linear in the points.
    """
    points = cut_lineage(collapse_copies(vectors, key, column))
    blocks = pack_blocks(points, column, block)
    pairs = cut_lineage(block_pairs(blocks, eps))
    core = cut_lineage(_neighbour_counts(blocks, pairs, eps).filter(F.col("n") >= min_samples).select("id"))
    flagged = cut_lineage(_with_flags(blocks, core.withColumn("flag", F.lit(1))))
    edges = _core_edges(flagged, pairs, eps).union(core.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    labels = components(edges)
    marked = cut_lineage(_with_flags(blocks, labels.select("id", (F.col("label") + 1).alias("flag"))))
    border = _border_links(marked, pairs, eps)
    placed = labels.union(border)
    by_vector = points.join(placed, "id", "left").select(
        F.col(column).alias("_v"), F.coalesce("label", F.lit(-1)).alias("cluster")
    )
    return vectors.join(by_vector, F.col(column) == F.col("_v")).select(key, "cluster")
