"""BLEU of joined tokens against the native expression; the overlap of near copies."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import bleu as bl
from palimpsest.operators import refine


def test_text_bleu(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        a = [rng.choice("abcdefg") for _ in range(rng.randint(1, 25))]
        b = [w if rng.random() < 0.9 else rng.choice("abcdefg") for w in a][: rng.randint(1, 25)]
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i int, r array<string>, h array<string>")
    scored = df.select("*", bl.bleu(F.col("r"), F.col("h")).alias("x"), bl.lengths_allow(F.size("r"), F.size("h"), 0.8).alias("ok"))
    found = scored.collect()
    for r in found:
        for threshold in (0.1, 0.8, 0.9):
            if abs(r.x - threshold) > 1e-9:
                assert bl.text_bleu_above(" ".join(r.r), " ".join(r.h), threshold) == (r.x > threshold), r
        assert r.ok or r.x <= 0.8
    assert any(r.x > 0.8 for r in found) and not all(r.ok for r in found)


def test_no_profile_of_unlike_rows(spark):
    """Only texts whose lengths allow a hit reach the comparison, as plain text:
    n-grams of every text were made and carried for each neighbour."""
    rng = random.Random(9)
    base = [rng.choice(["red", "green", "blue", "grey", "pink"]) for _ in range(60)]
    texts = {1: " ".join(base), 2: " ".join(base[:59] + ["odd"]), 3: " ".join(base[:20]), 4: " ".join(base) + " 12", 5: "", 6: None, 7: "x", 8: "x"}
    rows = [(i, t, t) for i, t in texts.items()]
    out = refine.overlap_flags(spark.createDataFrame(rows, "id int, comment string, src string"), ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "array_intersect" not in plan
    got = {r.id: r.overlap for r in out.collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False, 8: False}
