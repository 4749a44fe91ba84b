"""The query over replaced spans against a program that tries every state."""

from palimpsest import plans
from test_sequence import plain_steps


def test_query_against_plain_program(spark, tmp_path):
    lines = [
        ("the good-looking cat sat here", "the very good looking cats sit down here now"),
        ("one two three end", "ein zwei drei vier end"),
        ("same line", "same line"),
        ("a b c", "x"),
        ("alpha beta gamma delta", "omega alphas new words betas gammas deltas and more"),
    ]
    rows = []
    for n, (old, new) in enumerate(lines):
        head = f"heading number {n}"
        rows += [(2 * n + 1, f"{head}\n{old}", "en", "s"), (2 * n + 2, f"{head}\n{new}", "en", "s")]
    rows += [(90, None, None, None), (91, "", "en", "s"), (2, rows[1][1], "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = plans.QUERIES["k_align_insertions"](spark, str(tmp_path)).collect()
    assert got and len({(r.src_span, r.tgt_span) for r in got}) == len(got)
    for r in got:
        source, targets = r.src_span.split(" "), r.tgt_span.split(" ")
        cost, steps = plain_steps(source, targets, 1)
        assert r.cost == cost, r
        assert r.inserted == " ".join(w for i, j, k in steps if i < 0 for w in targets[j:k]), r
        assert r.plain_cost == plain_steps(source, targets, 0)[0] >= cost, r
    assert any(r.inserted for r in got)
