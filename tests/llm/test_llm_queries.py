"""Queries against SQL and plain programs; the pipeline stage by stage."""

import hashlib
from collections import Counter

import brute
import pytest
from compare import compare, connect

import corpus_pipeline
from palimpsest.llm import packing, quality
from palimpsest.llm.queries import ORACLES, QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


def test_shards_of_documents(spark, con):
    rows = QUERIES["op3_stratified_shards"](spark, FOLDER).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter(con.execute("SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 FROM documents").fetchall())
    counts = Counter(r["shard"] for r in rows)
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1


def test_suffix_dedup_of_documents(spark, con):
    rows = [(d, (t or "").encode()) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall()]
    want = {}
    for (d, b), mask in zip(rows, brute.byte_repeats(rows, 100)):
        kept = bytes(x for x, m in zip(b, mask) if not m)
        want[d] = (len(b), sum(mask), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op10_suffix_dedup"](spark, FOLDER).collect()}
    assert got == want


def test_packing_of_documents(spark):
    rows = QUERIES["op7_best_fit_packing"](spark, FOLDER).collect()
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_pipeline_stages(spark, odd, none):
    """Each stage on what its predecessor left, against plain programs."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(
        odd.selectExpr("doc_id + 100000 AS doc_id", "text", "label AS lang", "source", "cast(n as bigint) AS n_chars")
    )
    left = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.written(stage(spark, left, FOLDER), "stage")
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        given, got = [tuple(r) for r in left.collect()], [tuple(r) for r in out.collect()]
        if name == "quality rules":
            good = {r["doc_id"] for r in quality.report(left).collect() if r["kept"]}
            assert Counter(got) == Counter(r for r in given if r[0] in good)
        elif name == "exact dedup":
            best = {}
            for r in given:
                best[r[1] or ""] = max(best.get(r[1] or "", -1), r[0] if r[0] is not None else -1)
            assert sorted((r[1], r[0]) for r in got) == sorted(best.items())
        elif name == "near dedup":
            root = brute.near_groups([(r[0], r[1]) for r in given])
            assert Counter(got) == Counter(r for r in given if root[r[0]] == r[0])
        else:
            assert set(got) <= set(given) and max(Counter(got).values()) <= 2
            total = sum(len(brute.words(r[1])) for r in given)
            assert sum(len(brute.words(r[1])) for r in got) == pytest.approx(1.5 * total, rel=0.05)
        left = out
    pieces = corpus_pipeline.STAGES[4][1](spark, left, FOLDER).collect()
    words = packing.WordIds(tokenizer_path())
    assert sum(r["length"] for r in pieces) == sum(len(words.of([r["text"]])[0]) // 4 for r in left.collect())
    assert len({r["sequence_id"] for r in pieces}) <= -(-sum(r["length"] for r in pieces) // 2048) + 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), FOLDER).count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
