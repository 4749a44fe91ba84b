"""Sentences against the plain pattern; queries over them make them once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest import plans
from palimpsest.functions import text as tx
from palimpsest.functions.collections import present


def test_split_against_pattern(spark):
    rng = random.Random(2)
    texts = [None, "", "\n", "...", "。", "a.b\n!c"] + ["".join(rng.choice("a.!。？ \n\t\ré\U0001f600") for _ in range(rng.randint(0, 14))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    pattern = r"[^.!?。！？\n]*[.!?。！？]+|[^.!?。！？\n]+"
    for r in df.select("text", tx.split_sentences(F.col("text")).alias("s")).collect():
        want = None if r.text is None else [s for s in (x.strip(tx.SPACE) for x in re.findall(pattern, r.text)) if s]
        assert r.s == want, r.text


def test_present(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "i int")
    made = df.select("i", present(F.when(F.col("i") > 1, F.struct(F.col("i").alias("a"), F.lit(None).cast("int").alias("b")))))
    assert [tuple(r) for r in made.collect()] == [(2, 2, None)]


@pytest.mark.parametrize("name", ["h_map_context", "h_extend_sentences", "h_context_window", "b_unchanged_filter"])
def test_made_once(spark, name):
    """No filter that repeats the splitting below the step that needs it."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1, plan
