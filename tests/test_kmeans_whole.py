"""The registered k-means queries run the reference's whole job."""

import numpy as np
import pytest

from palimpsest import plans
from palimpsest.operators import cluster, kmeans


@pytest.fixture(scope="module")
def blobs(spark, tmp_path_factory):
    """Ten blobs of different sizes around unit directions of 24 dimensions."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 24))
    labels = np.repeat(np.arange(10), range(8, 28, 2))
    x = centres[labels] / np.linalg.norm(centres[labels], axis=1, keepdims=True) + rng.normal(scale=0.04, size=(len(labels), 24))
    folder = tmp_path_factory.mktemp("blobs")
    rows = [(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, labels))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(str(folder / "embeddings.parquet"))
    return str(folder), x.astype(np.float32).astype(float), labels


def plain_cost(x, k, starts=100):
    best = np.inf
    for seed in range(starts):
        rng = np.random.default_rng(seed)
        c = x[[rng.integers(len(x))]]
        while len(c) < k:  # k-means++
            d = ((x[:, None] - c) ** 2).sum(-1).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())]])
        for _ in range(50):
            near = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
            c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        best = min(best, ((x[:, None] - c) ** 2).sum(-1).min(1).sum())
    return best


def test_all_dimensions_are_kept(spark, blobs):
    assert {r.dims for r in plans.QUERIES["j_vectors"](spark, blobs[0]).collect()} == {24}


def test_queries_ask_for_all_restarts_and_reach_the_plain_cost(spark, blobs, monkeypatch):
    folder, x, labels = blobs
    asked, fit = [], cluster.fit_kmeans

    def watched(*args, **options):
        asked.append((options.get("n_init"), options.get("max_iter")))
        return fit(*args, **options)

    monkeypatch.setattr(cluster, "fit_kmeans", watched)
    sizes = sorted(r.n for r in plans.QUERIES["j_kmeans"](spark, folder).collect())
    found = {r.vec_id: r.cluster for r in plans.QUERIES["j_kmeans_predict"](spark, folder).collect()}
    assert asked == [(16, 300)] * 2
    assert sizes == sorted(np.bincount(labels))
    got = np.array([found[i] for i in range(len(x))])
    cost = sum(((x[got == j] - x[got == j].mean(0)) ** 2).sum() for j in set(got))
    assert cost <= plain_cost(x, 10) * 1.001


def plain_lloyd(x, c, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - c) ** 2).sum(-1).argmin(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    d = ((x[:, None] - c) ** 2).sum(-1)
    return c, np.bincount(d.argmin(1), minlength=len(c)), d.min(1).sum()


@pytest.mark.parametrize("direct", [1, 64])
def test_rounds_of_all_restarts_equal_plain_ones(spark, monkeypatch, direct):
    """Each restart goes its own way, whether partial sums meet in a tree or not;
    centres without rows stay."""
    monkeypatch.setattr(kmeans, "_DIRECT", direct)
    monkeypatch.setattr(kmeans, "_ROWS", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(9)
    starts = np.stack([x[:4], x[4:8], np.vstack([x[:3], [[90.0] * 5]])])
    centres, counts, costs = kmeans.lloyd(kmeans.pack(df, "v"), starts, max_iter=6, tol=0.0)
    for r in range(3):
        c, n, cost = plain_lloyd(x, starts[r], 6)
        assert np.allclose(centres[r], c) and counts[r].tolist() == n.tolist() and costs[r] == pytest.approx(cost)
    assert counts[2][3] == 0 and np.allclose(centres[2][3], 90.0)


def test_fit_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    a = kmeans.fit_kmeans(df.coalesce(1), "v", k=6, n_init=4)
    b = kmeans.fit_kmeans(df.repartition(11), "v", k=6, n_init=4)
    assert np.allclose(a.points, b.points) and a.cost == pytest.approx(b.cost)


def test_passes_do_not_grow_with_restarts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(np.eye(4), 30, axis=0) + rng.normal(scale=0.01, size=(120, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    passes, one = [], kmeans.reduced
    monkeypatch.setattr(kmeans, "reduced", lambda *a: passes.append(1) or one(*a))
    kmeans.fit_kmeans(df, "v", k=4, n_init=8)
    assert len(passes) < 16


def test_few_and_equal_vectors(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)] + [(9, None)], "id long, v array<double>")
    model = kmeans.fit_kmeans(df, "v", k=3, n_init=2)
    assert model.points.shape == (3, 2) and model.cost == pytest.approx(0)
    model.save(spark, str(tmp_path / "m"))
    again = kmeans.Centres.load(spark, str(tmp_path / "m"))
    assert np.array_equal(again.points, model.points) and again.cost == model.cost
    rows = {r.id: r.cluster for r in kmeans.assign(df, "v", again).collect()}
    assert rows[9] is None and {rows[i] for i in range(5)} == {0}
    with pytest.raises(ValueError):
        kmeans.fit_kmeans(df.filter("false"), "v", k=2)


def test_few_partial_results_reach_the_driver(spark):
    """Forty tasks sent one result each in every pass; merges in tasks leave no trace here."""
    vectors = spark.range(400, numPartitions=40).selectExpr("array(cast(id as double), 1d) AS v")
    blocks = kmeans.pack(vectors, "v")
    calls = []

    def merge(a, b):
        calls.append(1)
        return a + b

    assert kmeans.reduced(blocks, lambda x: x.sum(0), merge).tolist() == [400 * 399 / 2, 400.0]
    assert len(calls) < 16
