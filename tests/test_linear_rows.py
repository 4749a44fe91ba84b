"""Row expressions on long rows, entities, file order, JSON lines and verb pairs."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions.collections import prefix_sums
from palimpsest.operators import annotate as an, context
from palimpsest.sources import readers


def test_prefix_sums_of_any_length(spark):
    rng = random.Random(5)
    for n in (0, 1, 255, 256, 257, 600, 20_000):
        sizes = [rng.randrange(9) for _ in range(n)]
        want = [0]
        for x in sizes:
            want.append(want[-1] + x)
        df = spark.createDataFrame([(sizes,)], "a array<int>")
        assert df.select(prefix_sums(F.col("a"))).first()[0] == want


def test_context_of_many_changes(spark):
    rng = random.Random(6)
    sents = [["ab"] * rng.randrange(4) for _ in range(3000)]
    tokens = [w for s in sents for w in s]
    diff = rng.sample(range(len(tokens)), len(tokens) // 3)
    df = spark.createDataFrame([(sents, tokens, diff)], "s array<array<string>>, t array<string>, d array<int>")
    found = df.select(
        context.sentence_of_token(F.col("s"), F.col("t"), F.col("d")), context.context_window(F.col("t"), F.col("d"), 2)
    ).first()
    owner = [i for i, s in enumerate(sents) for _ in s]
    assert found[0] == sorted({owner[d] for d in diff})
    near = sorted({i for d in diff for i in range(d - 2, d + 3) if 0 <= i < len(tokens)})
    assert [(x.pos, x.action) for x in found[1]] == [(i, int(i in set(diff))) for i in near]


def test_numeric_references(spark):
    texts = ["caf&#233; &#xE9;&#x1F600;", "&#38;lt; &lt;", "&#; &#x; a&#12", "&#0;&#xD800;&#9999999;", None, ""]
    want = ["café é\U0001f600", "&lt; <", "&#; &#x; a&#12", "���", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(tx.unescape(F.col("t"))).collect()] == want


def test_parts_in_written_order(spark):
    names = [f"/x/part-{i:05d}-a.txt" for i in (99_998, 99_999, 100_000, 100_001, 1_000_000)] + ["/x/plain.txt"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r.f for r in df.orderBy(readers.part_order(F.col("f"))).collect()] == names


def test_json_lines(spark, tmp_path):
    lines = ['{"text":"ok","n":1}', '{"text":"cut" "x"}', "{ plain braces }", "plain", '{"n":2}', ""]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    read = lambda **how: [r.text for r in readers.read_jsonl(spark, str(tmp_path), **how).orderBy("id").collect()]
    assert read() == ["ok", *lines[1:4]]
    assert read(json=False) == lines[:5]
    with pytest.raises(Exception, match="no JSON object"):
        read(json=True)


def test_first_verb_of_a_key_wins(spark):
    pairs = spark.createDataFrame([(1, "he go home", "he goes home"), (2, "he go home", "he went home"), (3, "a", "a")], "pair_id int, src string, tgt string")
    lexicon = spark.createDataFrame([("go", "goes", "VB", "VBZ", 1), ("go", "went", "VB", "VBZ", 2)], "w1 string, w2 string, t1 string, t2 string, row_no int")
    found = {r.pair_id: [op for ops in r.labels for op in ops] for r in an.annotate(pairs, lexicon=lexicon).collect()}
    assert "$TRANSFORM_VERB-goes" in found[1] and "$REPLACE_went" in found[2] and set(found[3]) == {"$KEEP"}
