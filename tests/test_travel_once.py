"""Work that is done, and rows that travel, once."""

import random

from pyspark.sql import functions as F

from palimpsest import plans
from palimpsest.operators import annotate as an, cluster, features, pairing

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_generation_records_split_the_text_once(spark):
    assert plan(plans.QUERIES["i_generation_records"](spark, SMALL)).count("split(text") == 1


def test_binding_does_not_copy_the_result(spark):
    from palimpsest.functions.collections import bind

    df = spark.range(3).select(bind(F.col("id") + 1, lambda x: F.array(x, x * 2)).alias("a"))
    assert [r.a for r in df.orderBy("a").collect()] == [[1, 2], [2, 4], [3, 6]]
    assert "transform(" not in plan(df)


def test_sections_are_cut_once(spark):
    df = spark.createDataFrame([("A", "== A ==\nold\n== B ==\nx", "== A ==\nnew\n== B ==\nx")], "title string, parent_text string, text string")
    cut = pairing.sections_of_pairs(df)
    assert [(r.src_text, r.tgt_text) for r in cut.collect()] == [("old", "new")]
    assert plan(cut).count("regexp_instr(") == 2  # one a side
    assert pairing.sections_of_pairs(df, max_chars=3).isEmpty()


def test_terms_are_counted_once_and_only_those_asked_for(spark):
    docs = spark.createDataFrame([(1, "aa bb 12 7x"), (2, "aa cc cc"), (3, "bb dd"), (4, None)], "id int, t string")
    every = features.tfidf(docs, "id", "t")
    assert "regexp_extract_all" not in plan(every)  # the counts are read back
    some = features.tfidf(docs, "id", "t", spark.createDataFrame([(2,), (2,), (9,)], "id int"))
    rows = lambda df: sorted((r.id, r.term, round(r.weight, 12)) for r in df.collect())
    assert rows(some) == [r for r in rows(every) if r[0] == 2]
    assert {r[1] for r in rows(every) if r[0] == 1} == {"aa", "bb", "#NUMBER"}


def test_labels_of_long_keys_meet_block_by_block(spark):
    rng = random.Random(7)
    lengths = {1: 0, 2: 1, 3: 4095, 4: 4096, 5: 9000}
    edits = [(k, p, s, f"op{s}") for k, n in lengths.items() for p in {rng.randrange(-1, n + 3) for _ in range(n // 3 + 2)} for s in range(2)]
    edits = [e for e in edits if e[1] >= -1]
    rng.shuffle(edits)
    table = spark.createDataFrame([*edits, (2, 0, 9, None)], "pair_id int, pos int, seq int, op string")
    found = an.labels_from_table(table, spark.createDataFrame(list(lengths.items()), "pair_id int, n_tokens int"))
    want = {(k, p): ["$KEEP"] for k, n in lengths.items() for p in range(-1, n)}
    for k, p, s, op in sorted([*edits, (2, 0, 9, None)], key=lambda e: e[:3]):
        if (k, p) in want:
            want[k, p] = [op] if want[k, p] == ["$KEEP"] else want[k, p] + [op]
    rows = found.collect()
    assert len(rows) == len(want) and {(r.pair_id, r.pos): r.ops for r in rows} == want
    assert dict(found.dtypes)["pos"] == "int"
    assert "_block" in next(x for x in plan(found).splitlines() if "Join" in x)


def test_blocks_travel_once_per_tile(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    blocks = cluster.pack_blocks(cluster.collapse_copies(df, "id", "v"), "v", 16)
    assert blocks.filter(F.length("vectors") != 4 * 4 * F.size("ids")).isEmpty()  # floats stay floats
    pairs = cluster.block_pairs(blocks, 0.5)
    sent = pairs.select("tile", F.explode(F.array("a", "b")).alias("block")).distinct().count()
    assert sent * 2 < 2 * pairs.count()
    doubles = cluster.pack_blocks(cluster.collapse_copies(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v"), "v", 16)
    assert doubles.filter(F.length("vectors") != 8 * 4 * F.size("ids")).isEmpty()



def test_a_worker_keeps_its_word_table():
    from palimpsest.llm import packing, queries

    words = packing.word_ids(queries.tokenizer_path())
    first = words.of(["one two", None])
    again = packing.word_ids(queries.tokenizer_path())
    assert again is words and "two" in again.known
    assert again.of(["one two", None]) == packing.WordIds(queries.tokenizer_path()).of(["one two", None]) == first
