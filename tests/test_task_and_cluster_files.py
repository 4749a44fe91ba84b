"""Task files of three kinds, aligned text per cluster, saved reducers, seeded choice."""

from collections import Counter

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from palimpsest.functions.collections import index_range
from palimpsest.operators import context, features
from palimpsest.sources import readers, writers


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_text('id,tokens,x_tags,mask\n1,a b,K K,1 0\n2,"c ""q"" d",K D K,1 1 1\n3,only\n4,e,K,1,too,many\n')
    (tmp_path / "b.json").write_text('{"words": ["a", "b"], "tags": ["K", "D"]}\nno json\n{"words": ["c"]}\n')
    (tmp_path / "c.txt").write_text("a b\tK D\nno tab\nx\ty\tz\n\nc\tK\n")
    return tmp_path


def rows(df):
    return Counter((tuple(r.tokens), tuple(r.labels), None if r["mask"] is None else tuple(r["mask"])) for r in df.filter("bad is null").collect())


def test_kinds_and_columns(spark, files):
    a = readers.read_task_file(spark, str(files / "a.csv"), "x")
    assert rows(a) == Counter([(("a", "b"), ("K", "K"), ("1", "0")), (("c", '"q"', "d"), ("K", "D", "K"), ("1", "1", "1"))])
    assert a.filter("bad is not null").count() == 2
    # without names of the convention the first two columns count (JSON readers sort them)
    b = readers.read_task_file(spark, str(files / "b.json"), "x")
    assert b.columns == ["tokens", "labels", "mask", "bad"] and b.filter("bad is null").count() == 1
    assert b.filter("bad is not null").count() == 2
    c = readers.read_task_file(spark, str(files / "c.txt"), "x")
    assert rows(c) == Counter([(("a", "b"), ("K", "D"), None), (("c",), ("K",), None)])
    assert sorted(r.bad for r in c.filter("bad is not null").collect()) == ["", "no tab", "x\ty\tz"]
    with pytest.raises(ValueError):
        readers.read_task_file(spark, str(files / "d.bin"))


def test_lists_of_files(spark, files):
    train, valid = [str(files / n) for n in ("a.csv", "c.txt")], [str(files / n) for n in ("c.txt", "a.csv")]
    good, bad = readers.load_task_files(spark, train, valid, "x")
    assert Counter((r.task, r.split) for r in good.collect()) == {(0, "train"): 2, (1, "train"): 2, (0, "validation"): 2, (1, "validation"): 2}
    assert Counter((r.task, r.split) for r in bad.collect()) == {(0, "train"): 2, (1, "train"): 3, (0, "validation"): 3, (1, "validation"): 2}
    few, _ = readers.load_task_files(spark, train, valid, "x", debug_rows=1)
    assert few.count() == 4 and "Sort" not in few._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        readers.load_task_files(spark, train, valid[:1])


def test_old_task_union_keeps_its_limit(spark):
    frames = [spark.range(10).select(F.array(F.col("id").cast("string")).alias("tokens"), F.array(F.lit("K")).alias("mask")) for _ in range(2)]
    assert Counter(r.task for r in readers.load_tasks(frames, debug_rows=3).collect()) == {0: 3, 1: 3}


def pairs_of(spark, n, shift=0):
    hot = F.when(F.col("id") % 3 > 0, "hot/1").otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string")))
    return spark.range(n).select(
        F.col("id").alias("no"), hot.alias("cluster"), F.concat(F.lit("s "), F.col("id") + shift).alias("src"), F.concat(F.lit("t\n"), F.col("id") + shift).alias("tgt")
    )


def test_aligned_text_per_cluster(spark, tmp_path):
    df = pairs_of(spark, 500).repartition(7)
    writers.write_parallel_by_cluster(df, "no", str(tmp_path), rows_per_file=40)
    got = Counter(tuple(r) for r in readers.read_parallel_by_cluster(spark, str(tmp_path)).collect())
    assert got == Counter((r.cluster, r.src, r.tgt.replace("\n", " ")) for r in df.collect())
    assert len(list((tmp_path / "src").glob("cluster=hot*/*.txt"))) >= 333 // 40
    # a second run replaces the clusters it has and leaves the others
    only = pairs_of(spark, 500, 1000).filter("cluster = 'c3'")
    writers.write_parallel_by_cluster(only, "no", str(tmp_path))
    again = Counter(tuple(r) for r in readers.read_parallel_by_cluster(spark, str(tmp_path)).collect())
    want = Counter({k: v for k, v in got.items() if k[0] != "c3"}) + Counter((r.cluster, r.src, r.tgt.replace("\n", " ")) for r in only.collect())
    assert again == want


def test_a_lost_line_is_an_error(spark, tmp_path):
    writers.write_parallel_by_cluster(pairs_of(spark, 30).coalesce(1), "no", str(tmp_path))
    victim = next((tmp_path / "tgt").glob("cluster=c*/*.txt"))
    (victim.parent / f".{victim.name}.crc").unlink()
    victim.write_text(victim.read_text().rstrip("\n").rsplit("\n", 1)[0] + "\n")
    with pytest.raises(Exception, match="lines differ"):
        readers.read_parallel_by_cluster(spark, str(tmp_path)).collect()


def test_saved_reducer(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(40, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    stage = features.fit_reducer(df, "v", k=3, out="z")
    Pipeline(stages=[stage]).fit(df).write().overwrite().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p")).transform(df)
    plain = features.reduce_vectors(df, "v", k=3)
    a = np.array([r.z for r in loaded.orderBy("id").collect()])
    b = np.array([r.reduced for r in plain.orderBy("id").collect()])
    assert np.allclose(a, b) and a.shape == (40, 3) and np.allclose(np.linalg.norm(a, axis=1), 1)
    stage.write().overwrite().save(str(tmp_path / "s"))
    assert features.VectorReducer.load(str(tmp_path / "s")).getOrDefault("normalize") is True


def test_bottom_k_is_a_stable_sample(spark):
    df = spark.range(200).select("id", context.bottom_k(index_range(F.lit(20)), F.col("id"), 5, 3).alias("x"))
    found = {r.id: r.x for r in df.collect()}
    assert found == {r.id: r.x for r in df.repartition(7).collect()}
    assert all(len(v) == 5 and v == sorted(set(v)) for v in found.values())
    hits = Counter(i for v in found.values() for i in v)
    assert len(hits) == 20 and max(hits.values()) < 90  # 50 each on average
    short = spark.range(3).select(context.bottom_k(index_range(F.lit(2)), F.col("id"), 5).alias("x"))
    assert {tuple(r.x) for r in short.collect()} == {(0, 1)}


def test_records_of_odd_pairs(spark):
    schema = (
        "page_id long, rev_id long, parent_id long, comment string, src_sents array<string>, src_tokens array<array<string>>, src_diff array<int>, "
        "tgt_sents array<string>, tgt_tokens array<array<string>>, tgt_diff array<int>"
    )
    data = [
        (1, 2, 1, "POV fix now", ["a b.", "cc d."], [["a", "b", "."], ["cc", "d", "."]], [3], ["a b.", "dd d."], [["a", "b", "."], ["dd", "d", "."]], [3]),
        (1, 3, 2, None, [], [], [], ["new one."], [["new", "one", "."]], [0, 1, 2]),
        (1, 4, 3, "same", ["x."], [["x", "."]], [], ["x."], [["x", "."]], []),
    ]
    others = spark.createDataFrame([(1, 2, ["other words"]), (9, 3, ["of another page"])], "page_id long, rev_id long, negatives array<string>")
    got = {r.rev_id: r for r in context.context_records(spark.createDataFrame(data, schema), others, window=1, k=4).collect()}
    assert set(got) == {2, 3}  # a pair without a change gives no record
    assert (got[2].src_token, got[2].src_action) == ([".", "cc", "d"], [0, 1, 0])
    assert (got[2].pos_edits, got[2].neg_edits, got[2].neg_comments) == (["dd d."], ["a b."], [["other", "words"]])
    assert (got[3].src_token, got[3].tgt_action, got[3].neg_edits, got[3].neg_comments) == ([], [1, 1, 1], [], [])
