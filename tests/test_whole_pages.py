"""Page histories taken whole: all comments, and parents of their own page only."""

from pyspark.sql import functions as F

from palimpsest import plans
from palimpsest.operators import pairing


def test_negatives_come_from_the_whole_page(spark):
    sizes = {1: 30, 2: 4, 3: 1, 4: 11}
    rows = [(p, i, p * 100 + i, f"comment number {p} {i}") for p, n in sizes.items() for i in range(n)]
    kept = spark.createDataFrame(rows, "page_id long, rev_ord int, rev_id long, comment string")
    got = {(r.page_id, r.rev_id): r.negatives for r in pairing.negative_comments(kept).collect()}
    assert len(got) == len(rows)
    for p, i, rev, _ in rows:
        near = sorted((j for j in range(sizes[p]) if j != i), key=lambda j: (abs(i - j), j))[:10]
        assert got[p, rev] == [f"comment number {p} {j}" for j in sorted(near)]
    listed = {(r.page_id, r.comment_no): r.comment for r in pairing.comment_rows(kept).collect()}
    assert listed == {(p, i + 1): c for p, i, _, c in rows}


def test_long_conversations_pair_inside_themselves(spark, tmp_path):
    """From turn 1000 on an id of the view repeats on the next page."""
    turns = [(c, i, "user", f"POV words of {c} at {i}") for c, n in ((1, 1010), (2, 10), (3, 3)) for i in range(n)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    kept = {(c, c * 1000 + i) for c, i, *_ in turns}
    want = sorted((p, r, r - 1) for p, r in kept if (p, r - 1) in kept)
    for name in ("c_revision_pairs", "s_pairs"):
        rows = plans.QUERIES[name](spark, str(tmp_path)).select("page_id", "rev_id", "parent_id").collect()
        assert sorted(tuple(r) for r in rows) == want, name
    looked = plans.QUERIES["c_comment_lookup"](spark, str(tmp_path)).select("parent_comment").filter(F.col("parent_comment").isNotNull())
    assert looked.count() == len(want)
