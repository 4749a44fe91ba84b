import pytest

#: Nulls in every column, empty and blank texts, ties, repeated rows, a long text,
#: columns whose names the operators use inside.
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron", "a"),
    (3, "", "b"),
    (4, None, None),
    (5, " \n\t ", "b"),
    (None, "alpha beta gamma", "a"),
    (None, None, None),
    (6, "one two", None),
    (7, "one two", "c"),
    (8, LONG, "c"),
    (9, LONG + " tail", "c"),
    (10, "x " * 400, "d"),
    (11, "é\U0001f600 " * 60 + "MIT License and the Apache License, Version 2.0", "d"),
    (12, "one two", "c"),
    (13, "aaaa" * 200, "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, None if i % 2 else i, "x", float(i)) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, length int, label string, n double").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
