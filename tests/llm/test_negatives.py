import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.llm.negatives import _Rows, choose_references, hard_negatives, score_limits, scores

SCHEMA = "vec_id long, embedding array<double>, label int, n long, id long, v string, block long, kind int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 7, 7, "x", 7, 7, 7) for i, v, lab in rows], SCHEMA)


def mined(spark, rows, every=5, **options):
    found = hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, **options).collect()
    return sorted((tuple(r) for r in found), key=repr)


def brute(rows, every=5, positives=5, negatives=3):
    usable = [
        (i, [math.floor(256 * x) for x in v], lab)
        for i, v, lab in rows
        if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda x: (-x[0], x[1] is not None, x[1] or 0)
    out = []
    for n, (i, v, lab) in enumerate(usable):
        if i is None or i % every:
            continue
        others = [
            (max(min(sum(a * b for a, b in zip(v, w, strict=True)), 2**63 - 1), -(2**63) + 1), j, own == lab)
            for m, (j, w, own) in enumerate(usable)
            if m != n
        ]
        for goal, p, _ in sorted((x for x in others if x[2]), key=key)[:positives]:
            hard = sorted((x for x in others if not x[2] and 50 * goal <= 100 * x[0] <= 95 * goal), key=key)
            out += [(i, p, k + 1, j, goal, s) for k, (s, j, _) in enumerate(hard[:negatives])]
    return sorted(out, key=repr)


def clusters(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    labels = rng.integers(0, 4, n)
    vectors = centres[rng.integers(0, 12, n)] * 0.2 + rng.normal(size=(n, dims)) * 0.1
    return [(i, v.tolist(), int(lab)) for i, (v, lab) in enumerate(zip(vectors, labels, strict=True))]


@pytest.mark.parametrize("block", [1000, 40])
def test_like_brute_force(spark, block):
    rows = clusters(500, 12, 1)
    want = brute(rows)
    assert len(want) > 300
    assert mined(spark, rows, block_rows=block) == want


def test_many_ties_and_repeated_rows(spark):
    rows = [(i % 40, v, lab) for i, v, lab in clusters(200, 3, 2)]
    rows += [(1000 + i, [0.5, 0.25, 0.0], i % 2) for i in range(200)]
    assert mined(spark, rows, every=20, block_rows=50) == brute(rows, every=20)


def test_limits_hold_and_filter():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(300, 8)) * 1e-3, np.zeros((2, 8))]))
    vectors = np.concatenate([vectors, vectors[:5], -vectors[:5], vectors[:5] * 3])
    refs = choose_references(vectors, 8)
    norms = np.sqrt((vectors**2).sum(1))
    unit = vectors / np.where(norms > 0, norms, 1)[:, None]
    rows = _Rows(np.arange(len(vectors)), np.zeros(len(vectors)), vectors, norms, np.arccos(np.clip(unit @ refs.T, -1, 1)))
    least, most = score_limits(rows, rows)
    exact = scores(rows, rows, np.ones(least.shape, bool))
    assert (exact == vectors @ vectors.T).all()
    assert (least <= exact).all() and (exact <= most).all()
    # Half of the largest score is out of reach for most pairs.
    assert (most[:300, :300] < exact[:300, :300].max() / 2).mean() > 0.5


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.6, 0.0], 2), (3, [0.3, 0.0], 2), (None, [0.3, 0.0], 2),
        (4, [0.0, 0.0], 1), (5, [0.0, 0.0], 2), (6, [-1e-9, 1e-9], 3), (10, None, 1), (11, [nan, 1.0], 1),
        (12, [inf, 1.0], 2), (13, [None, 1.0], 2), (14, [1.0, 1.0], None), (15, [-1.0, 0.0], 1), (20, [-0.5, 0.0], 1),
    ]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [*rows, (25, [1.0], 1), (30, [], 1)]) == brute(rows)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(i, [x * 10.0**e for x in v], lab) for e in (4, 9, 30) for i, v, lab in clusters(40, 4, 5)]
    rows = [(n, v, lab) for n, (_, v, lab) in enumerate(rows)]
    assert mined(spark, rows, every=10) == brute(rows, every=10)


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)], [(0, [], 1), (1, [], 2)]])
def test_nothing_to_find(spark, rows):
    assert mined(spark, rows) == []
