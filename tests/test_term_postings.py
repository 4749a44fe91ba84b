"""tf-idf over blocks of postings: whole, and no row per document and term travels."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from palimpsest.operators import features, postings


def plain(docs):
    counts = defaultdict(Counter)
    for key, text in docs:
        counts[key].update(w for w in (text or "").split() if len(w) > 1)
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for key, c in counts.items():
        w = {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(key, t): x / norm for t, x in w.items()}
    return out


def corpus(keys):
    rng = random.Random(11)
    docs = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randrange(120)))) for k in keys]
    docs[3] = (docs[3][0], " ".join(["often"] * 70_000 + ["ever", "z"]))
    docs[4] = (docs[4][0], " ".join(f"rare{i}" for i in range(1500)))
    docs[5:8] = [(docs[5][0], None), (docs[6][0], ""), (docs[7][0], "a b c")]
    rng.shuffle(docs)
    return docs


def found(df, key="id"):
    rows = df.collect()
    out = {(r[key], r.term): r.weight for r in rows}
    assert len(out) == len(rows)
    return out


CASES = {
    "no key twice": (list(range(300)), "id int, t string"),
    "keys shared": ([i % 90 if i % 3 else i for i in range(300)], "id int, t string"),
    "one key many times, one missing": (["k" if i % 4 == 0 else f"d{i}" if i % 50 else None for i in range(300)], "id string, t string"),
    "missing keys": ([None if i % 7 == 0 else i for i in range(300)], "id bigint, t string"),
}


@pytest.mark.parametrize(("case", "words"), [*((case, 500) for case in CASES), ("no key twice", 1), ("keys shared", 1 << 21)])
def test_weights_are_those_of_a_plain_program(spark, case, words):
    keys, schema = CASES[case]
    docs = corpus(keys)
    table = spark.createDataFrame(docs, schema).repartition(3)
    want = plain(docs)
    assert found(features.tfidf(table, "id", "t", words=words)) == pytest.approx(want, abs=1e-12)
    asked = [k for k in keys if k is not None][::5]
    only = spark.createDataFrame([(k,) for k in [*asked, asked[0], None]], schema.split(",")[0])
    some = {x: w for x, w in want.items() if x[0] in set(asked)}
    assert found(features.tfidf(table, "id", "t", only, words)) == pytest.approx(some, abs=1e-12)


def test_blocks_are_bounded_by_words_bytes_and_documents():
    def blocks(texts, batch):
        kind = pa.list_(pa.string())
        given = pa.table({"key": list(range(len(texts))), "terms": pa.array([t and t.split() for t in texts], kind)})
        out = list(postings._blocks(iter(given.to_batches(batch)), 1 << 16))
        assert [k for b in out for k in b["key"].to_pylist()] == list(range(len(texts)))
        return [b.num_rows for b in out]

    assert max(blocks(["word " * 100] * 3000, 700)) <= 656
    assert max(blocks(["x" * 80_000, None] * 100, 30)) <= 16
    assert len(blocks([None] * 100, 7)) == 1
    assert max(blocks([""] * 70_000 + ["a"], 10_000)) <= 1 << 16
    assert max(blocks(["word " * 100_000] * 3, 2)) == 1


def test_nothing_to_weigh(spark):
    for docs in ([], [(1, None), (2, "a"), (2, "")]):
        out = features.tfidf(spark.createDataFrame(docs, "id int, t string"), "id", "t")
        assert out.collect() == [] and out.columns == ["id", "term", "weight"]


def exchanged(node) -> int:
    """Rows written by the exchanges of an executed plan."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return exchanged(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return exchanged(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(exchanged(node.children().apply(i)) for i in range(node.children().size()))


def test_no_row_per_document_and_term_travels(spark):
    docs = [(i, " ".join(f"word{(i * 7 + j) % 150}" for j in range(100))) for i in range(2000)]
    out = features.tfidf(spark.createDataFrame(docs, "id int, t string").coalesce(4), "id", "t")
    assert len(out.collect()) == 200_000
    assert exchanged(out._jdf.queryExecution().executedPlan()) < 20_000
