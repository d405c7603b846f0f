import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm.nearest import nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, leaf long, id long, qid long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 7, 7) for i, v in rows], SCHEMA)


def search(spark, rows, **options):
    found = nearest_neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, **options).collect()
    result = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        result.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return result


def exact(rows, query, k):
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    scores = sorted((-float((vectors[query] * v).sum()), i) for i, v in vectors.items() if i != query)
    return [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]


def test_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.5).tolist()) for i in range(3000)]
    got = search(spark, rows)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        want = exact(rows, q, 20)
        assert [n for n, _, _ in found] == list(range(1, 21))
        hits += len({i for _, i, _ in want} & {i for _, i, _ in found})
    assert hits / (20 * len(got)) >= 0.9


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (20, [1.0, 0.0]), (40, [0.0, 0.0]),
        (60, None), (80, []), (100, [nan, 1.0]), (120, [inf, 1.0]), (140, [None, 1.0]), (160, [1.0, 2.0, 3.0]),
        (None, [2.0, 0.0]), (180, [-1.0, -0.0]),
    ]
    got = search(spark, [*rows, (1, [1.0, 0.0])], k=4)
    assert set(got) == {0, 20, 180}
    assert got[0] == [(1, None, 2.0), (2, 1, 1.0), (3, 2, 1.0), (4, 20, 1.0)]
    assert got[20] == [(1, None, 2.0), (2, 0, 1.0), (3, 1, 1.0), (4, 2, 1.0)]
    assert [i for _, i, _ in got[180]] == [3, 0, 1, 2]


@pytest.mark.parametrize("rows", [[], [(20, None)], [(20, [1.0])]])
def test_nothing_to_find(spark, rows):
    assert search(spark, rows) == {}
