"""Names of the operators' own columns in the given table; repeated rows; words
that a weak hash would mix up."""

import hashlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import substring_dedup, suffix_dedup

FOLDER = "/root/testdata/sf0.001"
OWN = ["_rate", "_seed", "_copies", "_mix_source", "_q", "_at", "_gone", "_present", "_row", "row", "rate", "seed", "size", "length", "tag", "doc", "hash", "owner", "kept", "n", "label"]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs.select("*", *(F.lit(float(k)).alias(c) for k, c in enumerate(OWN)), F.lit("x").alias("a.b"))


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_clashing_columns(spark, clashing, k):
    """With and without the extra columns a stage keeps the same rows."""
    name, stage = corpus_pipeline.STAGES[k]
    plain = stage(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    out = stage(spark, clashing, FOLDER)
    assert out.columns == clashing.columns, name
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter(r["doc_id"] for r in plain.select("doc_id").collect())
    assert {tuple(r[len(plain.columns) :]) for r in out.collect()} == {(*(float(i) for i in range(len(OWN))), "x")}


def thue_morse(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_words_decide_not_hashes(spark):
    """Two long words that agree in every sum of powers modulo 2**64."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    shared = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {other}"), (3, f"{shared} {one} z")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 13}


@pytest.mark.parametrize("operator, length", [(suffix_dedup, 100), (substring_dedup, 13)])
def test_many_repeated_rows(spark, operator, length):
    """A thousand rows of one id and one text are one document's places, in linear time."""
    text = " ".join(f"v{i * 7919 % 6007}" for i in range(3000))
    rows = [(5, text)] * 1000 + [(9, text)] * 2 + [(5, "other " + text[:400]), (5, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    got = Counter((r["doc_id"], r["n_removed"]) for r in operator.remove_repeats(docs).select("doc_id", "n_removed").collect())
    if operator is suffix_dedup:
        small = [(5, text.encode()), (9, text.encode()), (5, ("other " + text[:400]).encode()), (5, b"other")]
        first = [sum(m) for m in brute.byte_repeats(small, length)]
        assert got == Counter([(5, first[0])] * 1000 + [(9, first[1])] * 2 + [(5, first[2]), (5, first[3])])
    else:
        assert got == Counter({(5, 0): 1002, (9, 3000): 2})


def test_digest_of_repeats(spark):
    rows = [(1, "q" * 250), (2, "p" + "q" * 120)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect())
    masks = brute.byte_repeats([(d, t.encode()) for d, t in rows], 100)
    want = Counter((d, 1, hashlib.sha256(bytes(x for x, m in zip(t.encode(), mask) if not m)).hexdigest()) for (d, t), mask in zip(rows, masks))
    assert got == want
