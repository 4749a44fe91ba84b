"""Ordered, clustering and source operators against brute force on small input."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import batches, cluster, features, lookups, ordering, pairing
from palimpsest.sources import readers, writers
from palimpsest.streaming import ingest


def hot_rows(spark, n=4000):
    """One group holds more than a third of the rows."""
    return spark.range(n).select(
        F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 50).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("o"),
        "id",
    )


@pytest.mark.parametrize("parts", [1, 8])
def test_index_and_rank(spark, parts):
    df = hot_rows(spark).repartition(parts)
    rows = sorted((r.g, r.o, r.id) for r in df.collect())
    got = {r.id: r.idx for r in ordering.with_index(df, ["g", "o", "id"], "idx").collect()}
    assert got == {r[2]: i for i, r in enumerate(rows)}
    seen, want = Counter(), {}
    for g, _, i in rows:
        want[i] = seen[g]
        seen[g] += 1
    ranked = ordering.group_rank(df, ["g"], ["o", "id"], "rank").collect()
    assert {r.id: r.rank for r in ranked} == want


def test_previous_in_group(spark):
    df = hot_rows(spark)
    last, want = {}, {}
    for g, o, i in sorted((r.g, r.o, r.id) for r in df.collect()):
        want[i] = last.get(g)
        last[g] = i
    got = ordering.previous_in_group(df, ["g"], ["o", "id"], ["id"]).collect()
    assert {r.id: r.prev_id for r in got} == want


def brute_dbscan(vectors, eps, least):
    m = np.array([v for _, v in vectors], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = 1 - m @ m.T <= eps
    np.fill_diagonal(near, True)
    ids = [i for i, _ in vectors]
    core = near.sum(1) >= least
    label = {}
    for s in np.argsort(ids):
        if core[s] and s not in label:
            stack = [s]
            label[s] = ids[s]
            while stack:
                x = stack.pop()
                for y in np.nonzero(near[x] & core)[0]:
                    if y not in label:
                        label[y] = ids[s]
                        stack.append(y)
    out = {}
    for x in range(len(ids)):
        mine = [label[y] for y in np.nonzero(near[x] & core)[0]]
        out[ids[x]] = label[x] if core[x] else (min(mine) if mine else -1)
    return out


@pytest.mark.parametrize("block", [16, 2048])
def test_dbscan(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    points = [list(map(float, centres[i % 4] + rng.normal(scale=0.35, size=6))) for i in range(150)]
    points += [points[0]] * 40 + [list(map(float, rng.normal(size=6))) for _ in range(30)]
    rows = list(enumerate(points))
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {r.id: r.cluster for r in cluster.dbscan(df, "id", "v", 0.08, 5, block).collect()}
    assert got == brute_dbscan(rows, 0.08, 5)
    m = np.array(points)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    first = {}
    for i, p in rows:
        first.setdefault(tuple(p), i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and 1 - m[a] @ m[b] <= 0.08}
    pairs = cluster.eps_pairs(df, "id", "v", 0.08, block).collect()
    assert {(r.a, r.b) for r in pairs} == want and len(pairs) == len(want)


def test_components_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.label for r in cluster.components(edges).collect()} == {0}


def test_components_of_random_graphs(spark, monkeypatch):
    """Chains with shuffled ids, a hub, lone nodes; forests that break off early."""
    monkeypatch.setattr(cluster, "_HELD", 3)
    rng = np.random.default_rng(4)
    names = rng.permutation(4000)
    edges = [(names[i], names[i + 1]) for i in range(700)]
    edges += [(names[800], names[i]) for i in range(801, 1500)]
    edges += [(names[int(a)], names[int(b)]) for a, b in rng.integers(1500, 2600, size=(500, 2))]
    edges += [(names[i], names[i]) for i in range(2700, 2720)] + edges[:50]
    edges = [(int(a), int(b)) for a, b in edges]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    got = cluster.components(df).collect()
    assert {r.id: r.label for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert cluster.components(df.limit(0)).count() == 0


def test_far_blocks_are_never_paired(spark):
    """32 far clusters of 64 points in blocks of up to 16: most block pairs of
    other clusters are not even made, and the clusters come out whole."""
    rng = np.random.default_rng(8)
    centres = np.eye(32)
    rows = [(i, list(map(float, centres[i % 32] + rng.normal(scale=0.01, size=32)))) for i in range(2048)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    blocks = cluster.pack_blocks(cluster.collapse_copies(df, "id", "v"), "v", 16, 128)
    made = cluster.candidate_pairs(blocks, 0.05)
    total = blocks.count()
    assert 128 <= total <= 256 and made.count() < total * (total + 1) / 2 / 8
    assert cluster.block_pairs(blocks, 0.05).count() <= made.count()
    got = {r.id: r.cluster for r in cluster.dbscan(df, "id", "v", 0.05, 5, 16).collect()}
    assert got == {i: i % 32 for i in range(2048)}


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "id bigint, v array<double>")
    assert cluster.dbscan(none, "id", "v").count() == 0
    assert cluster.eps_pairs(none, "id", "v", 0.1).count() == 0


def test_svd_matches_numpy(spark):
    m = np.random.default_rng(1).normal(size=(50, 6))
    df = spark.createDataFrame([(list(map(float, r)),) for r in m], "v array<double>").repartition(4)
    values, _ = features.fit_svd(df, "v", 3)
    assert np.allclose(values, np.linalg.svd(m, compute_uv=False)[:3])


def test_shards_are_equal(spark):
    out = batches.stride_shards(spark.range(23).toDF("x"), ["x"], 5, {"x": -1})
    sizes = Counter(r.shard for r in out.collect())
    assert set(sizes.values()) == {5} and out.filter("x = -1").count() == 2


def test_missing_cluster_raises(spark):
    pairs = spark.range(3).toDF("id")
    clusters = spark.range(2).select("id", F.lit(1).alias("cluster"))
    assert [r.id for r in lookups.missing_clusters(pairs, clusters).collect()] == [2]
    with pytest.raises(Exception, match="no cluster for id"):
        lookups.add_cluster_by_id(pairs, clusters).collect()


def test_parallel_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    (tmp_path / "b.txt").write_text("eins\nx\nzwei\n")
    got = readers.read_parallel(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).orderBy("line_no").collect()
    assert [(r.line_no, r.src, r.tgt) for r in got] == [(0, "one", "eins"), (2, "two", "zwei")]
    (tmp_path / "c.txt").write_text("eins\n")
    with pytest.raises(Exception, match="differ in length"):
        readers.read_parallel(spark, str(tmp_path / "a.txt"), str(tmp_path / "c.txt")).collect()


def test_checksums(spark, tmp_path):
    for name in ("f1", "f2"):
        (tmp_path / name).write_bytes(name.encode() * 1000)
    got = {r.name: r.md5 for r in readers.checksum_listing(spark, str(tmp_path), chunk=100).collect()}
    assert got == {n: hashlib.md5(n.encode() * 1000).hexdigest() for n in ("f1", "f2")}


def test_sample_files():
    names = [f"p{i}" for i in range(10)]
    assert readers.sample_files(names, 3, 1) == readers.sample_files(reversed(names), 3, 1)
    assert len(set(readers.sample_files(names, 10, 1))) == 10
    assert len(readers.sample_files(names, 20, 1, replace=True)) == 20


def test_cluster_folders(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 3).cast("int").alias("cluster"))
    writers.write_by_cluster(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "cluster=1")).count() == 3


def test_sampling_is_stable(spark):
    keep = pairing.sampled(F.col("id"), 0.3, 1)
    a = spark.range(1000).repartition(7).filter(keep).count()
    assert a == spark.range(1000).filter(keep).count() and 200 < a < 400


def test_stream_pairs_with_horizon(spark, tmp_path):
    rows = [(1, 10, None, "2024-01-01"), (1, 11, 10, "2024-01-02"), (1, 12, 10, "2024-03-01")]
    df = spark.createDataFrame(rows, "page_id long, rev_id long, parent_id long, ts string")
    schema = "page_id long, rev_id long, parent_id long, timestamp timestamp"
    df.select("page_id", "rev_id", "parent_id", F.to_timestamp("ts").alias("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.drain(ingest.stream_pairs(stream, "10 days"), str(tmp_path / "out"), str(tmp_path / "marks"))
    assert [r.rev_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [11]
