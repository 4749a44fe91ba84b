"""Worked examples and property checks of the text and tag functions."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import rules, sequence, tags, text as tx
from palimpsest.functions.bleu import bleu
from palimpsest.operators import annotate as an, context as cx, records as rec, refine


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def strings(*words):
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


PAIRS = [
    (1, "u looks nice.", "You look good."),
    (
        2,
        "this is a demo text for edting action annotation.",
        "This is demo text for editing action annotations.",
    ),
    (3, "well known fact", "well-known fact"),
    (4, "a well-known fact", "a well known fact"),
    (5, "same text", "same text"),
    (6, "b c", "a b x c d"),
]


@pytest.fixture(scope="module")
def annotated(spark):
    df = spark.createDataFrame(PAIRS, "pair_id int, src string, tgt string")
    return {r.pair_id: r for r in an.annotate(df, mode="space" if False else "word").collect()}


def labels(row):
    return [".".join(ops) for ops in row.labels]


def test_first_demo_pair(annotated):
    assert labels(annotated[1]) == [
        "$KEEP", "$REPLACE_You", "$TRANSFORM_AGREEMENT_SINGULAR", "$REPLACE_good", "$KEEP",
    ]


def test_second_demo_pair(annotated):
    want = ["$KEEP"] * 11
    want[1], want[3] = rules.CASE_CAPITAL, rules.DELETE
    want[7], want[9] = "$REPLACE_editing", rules.PLURAL
    assert labels(annotated[2]) == want


def test_equal_and_insertions(annotated):
    assert labels(annotated[5]) == ["$KEEP"] * 3
    assert labels(annotated[6]) == ["$APPEND_a", "$APPEND_x", "$APPEND_d"]


def test_round_trip(spark, annotated):
    df = spark.createDataFrame(PAIRS, "pair_id int, src string, tgt string")
    done = an.annotate(df, mode="space").select(
        "pair_id", "tgt", F.array_join(tags.apply_edits(F.col("src_tokens"), F.col("labels")), " ").alias("out")
    )
    for r in done.collect():
        assert r.out == r.tgt
    merged = [r for r in an.annotate(df, mode="space").collect() if r.pair_id == 3][0]
    assert labels(merged) == ["$KEEP", rules.MERGE_HYPHEN, "$KEEP", "$KEEP"]
    split = [r for r in an.annotate(df, mode="space").collect() if r.pair_id == 4][0]
    assert labels(split)[2] == rules.SPLIT_HYPHEN


def test_verb_lexicon(spark):
    df = spark.createDataFrame([(1, "he go home", "he went home")], "pair_id int, src string, tgt string")
    lexicon = spark.createDataFrame([("go", "went", "VB", "VBD")], "w1 string, w2 string, t1 string, t2 string")
    assert labels(an.annotate(df, lexicon=lexicon).first())[2] == "$TRANSFORM_VERB-went"


def test_case_tags(spark):
    want = {
        ("this", "This"): rules.CASE_CAPITAL,
        ("USA", "usa"): rules.CASE_LOWER,
        ("nasa", "NASA"): rules.CASE_UPPER,
        ("mcdonald", "mCdonald"): rules.CASE_CAPITAL_1,
        ("pdfs", "PDFs"): rules.CASE_UPPER_1,
        ("abc", "abd"): None,
    }
    for (s, t), tag in want.items():
        assert one(spark, x=tags.case_tag(F.lit(s), F.lit(t))).x == tag
        if tag:
            assert one(spark, x=tags.apply_tag(F.lit(s), F.lit(tag))).x == [t]


def test_unknown_transform_raises(spark):
    with pytest.raises(Exception, match="unknown transform"):
        one(spark, x=tags.apply_tag(F.lit("a"), F.lit("$TRANSFORM_NONE")))


def test_context_window(spark):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(18)), lambda i: i.cast("string"))
    diff = F.array(*[F.lit(i) for i in [2, 3, 4, 11, 12, 13, 14, 16]])
    w = one(spark, x=cx.context_window(tokens, diff, 2)).x
    assert [int(c.token) for c in w] == [*range(7), *range(9, 19)]
    assert [c.action for c in w] == [0, 0, 1, 1, 1, 0, 0, 0, 0, 1, 1, 1, 1, 0, 1, 0, 0]


def test_markup_and_sections(spark):
    wiki = F.lit("[[link name]] a&quot; bds&quot; ''markup''")
    assert one(spark, x=tx.clean_wiki_text(wiki)).x == 'link name a" bds" markup'
    assert one(spark, x=tx.clean_wiki_text(F.lit("&eacute;&#233;&amp;lt;"), full=True)).x == "éé&lt;"
    c = F.lit("/* History */ fix POV")
    assert one(spark, t=tx.section_title(c), r=tx.section_comment(c)) == ("History", "fix POV")
    page = F.lit("== A ==\nx\n=== A1 ===\nz\n== B ==\ny")
    assert one(spark, x=tx.section_text(page, F.lit("A"))).x == "x\n=== A1 ===\nz"
    assert one(spark, x=tx.section_text(page, F.lit("A"), compat=True)).x == "x"
    assert one(spark, x=tx.section_text(page, F.lit("B"))).x == "y"
    assert one(spark, x=tx.section_text(page, F.lit("nope"))).x == ""


def test_bleu_bounds(spark):
    t = strings(*"the cat sat on the mat".split())
    assert one(spark, x=bleu(t, t)).x == pytest.approx(1.0)
    assert one(spark, x=bleu(t, strings("dog", "ran"))).x == 0.0
    assert one(spark, x=bleu(t, strings())).x == 0.0


def test_strip_common_context(spark):
    def sents(*lengths):
        return F.array(*[F.array_repeat(F.lit(f"s{n}"), n) for n in lengths])

    r = one(spark, x=cx.strip_common_context(sents(5, 6, 2, 7), sents(5, 6, 3, 7), 10)).x
    assert (r.front, r.back, r.offset, r.fits) == (1, 1, 5, True)
    r = one(spark, x=cx.strip_common_context(sents(5, 20), sents(5, 21), 10)).x
    assert (r.front, r.back, r.fits) == (1, 0, False)
    r = one(spark, x=cx.strip_common_context(sents(1), sents(2), 10)).x
    assert (r.front, r.back, r.fits) == (0, 0, True)


def test_generation_and_slots(spark):
    tokens = strings("$START", "a", "b", "c", "d")
    ops = F.array(
        strings("$APPEND_x"), strings("$DELETE"), strings("$DELETE"), strings("$MERGE_HYPHEN"), strings("$KEEP")
    )
    r = one(spark, x=rec.generation_record(tokens, ops)).x
    assert [(i.token, i.mask) for i in r] == [
        ("$START", 0), ("x", 1), ("[DELETE]", 0), ("a", 0), ("b", 0), ("[/DELETE]", 0), ("c-d", 0),
    ]
    filled = rec.fill_slots(strings("a", "[DELETE]", "b", "[/DELETE]", "[MASK]", "c"), strings("z"))
    assert one(spark, x=filled).x == ["a", "z", "c"]
    with pytest.raises(Exception, match="differ in number"):
        one(spark, x=rec.fill_slots(strings("[MASK]"), strings("y", "z")))


def test_overlap_drops_both_members(spark):
    rows = [(i, f"fix the spelling of word {i}", f"some quite plain sentence number {i} here") for i in (1, 2)]
    rows += [(3, "another thing entirely changed", "no likeness to the others at all")]
    df = spark.createDataFrame(rows, "id int, comment string, src string")
    got = {r.id: r.overlap for r in refine.overlap_flags(df, ["id"]).collect()}
    assert got == {1: True, 2: True, 3: False}
    single = refine.overlap_flags(df.limit(1), ["id"]).collect()
    assert [r.overlap for r in single] == [False]


def test_diff_ops_match_difflib(spark):
    a, b = "a b c d e".split(), "a x c e f".split()
    ops = one(spark, x=F.lit(1)) and spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(
        sequence.diff_ops("a", "b").alias("x")
    ).first().x
    assert [tuple(o) for o in ops] == sequence.opcodes(a, b)
