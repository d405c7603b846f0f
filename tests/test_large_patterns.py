import random
import re

import pytest
from pyspark.sql import functions as F

from logspark.functions import patterns
from logspark.functions.patterns import matches_any, shortest_only


def texts(rng, n=400):
    return ["".join(rng.choice("abcé日 .\n") for _ in range(rng.randrange(30))) for _ in range(n)] + ["", None]


def found(spark, rows, wanted):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    return {r.i: r.hit for r in table.select("i", matches_any(F.col("t"), wanted).alias("hit")).collect()}


def literals(rng, n, longest=7):
    return ["".join(rng.choice("abcé日 ") for _ in range(rng.randrange(3, longest))) for _ in range(n)]


@pytest.mark.parametrize("part", [patterns.AUTOMATON_BYTES, 50])
def test_many_literals(spark, monkeypatch, part):
    monkeypatch.setattr(patterns, "AUTOMATON_BYTES", part)
    rng = random.Random(7)
    rows, wanted = texts(rng), literals(rng, 40)
    got = found(spark, rows, wanted)
    want = {i: None if t is None else any(w in t for w in wanted) for i, t in enumerate(rows)}
    assert got == want and {True, False} <= set(got.values())


def test_many_literals_and_expressions(spark):
    rng = random.Random(8)
    rows = texts(rng)
    exprs = [f"{a}{b}[.]$" for a in "abcé日 " for b in "abcé日 "] + ["^(?i)B+a", r"(?P<x>c)\.c", "x|y"]
    wanted = literals(rng, 30, 9) + exprs
    python = [re.compile(e.replace("^(?i)B+a", "(?i:^B+a)").replace("$", r"\Z")) for e in exprs]
    got = found(spark, rows, wanted)
    for i, t in enumerate(rows):
        if t is not None:
            assert got[i] == (any(w in t for w in wanted[:30]) or any(p.search(t) for p in python)), t


def test_empty_literal_among_many(spark):
    assert found(spark, ["x", "", None], ["", *[f"w{i}" for i in range(100)]]) == {0: True, 1: True, 2: None}


def test_plan_does_not_grow(spark):
    table = spark.createDataFrame([("x",)], "t string")
    sizes = []
    for n in (100, 10_000):
        df = table.where(matches_any(F.col("t"), [f"literal {i:05}" for i in range(n)]))
        sizes.append(len(df._jdf.queryExecution().executedPlan().toString()))
        assert df.count() == 0
    assert sizes[0] == sizes[1]


def test_shortest_only():
    rng = random.Random(9)
    words = literals(rng, 200)
    kept = shortest_only(words)
    assert all(any(w.startswith(k) for k in kept) for w in words)
    assert not any(a != b and a.startswith(b) for a in kept for b in kept)
