import re
from collections import defaultdict

import pytest

import rows
from logspark.llm.mixing import mix


def fill(words, weights, share=1.5, cap=2):
    """Targets by clamping and resharing until nothing is above its cap."""
    total, open_ = share * sum(words.values()), set(words)
    while True:
        left = total - sum(cap * words[s] for s in words if s not in open_)
        target = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        above = {s for s in open_ if target[s] > cap * words[s]}
        if not above:
            return {s: target.get(s, cap * words[s]) for s in words}
        open_ -= above


def check(spark, data):
    got = mix(rows.documents(spark, data)).collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.id), str(r.source), r.size) for r in got) == sorted((str(i), str(s), size(t)) for i, t, _, s in data)
    words = defaultdict(int)
    for _, t, _, s in data:
        words[s] += size(t)
    names = sorted(words, key=lambda s: (s is None, s or ""))
    target = fill(words, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == words[r.source]
        assert r.target == pytest.approx(target[r.source])
    for s in names:
        assert abs(taken[s] - target[s]) < 1.0001
    return sorted((str(r.id), str(r.source), r.size, r.taken) for r in got)


def test_awkward_rows(spark):
    assert check(spark, rows.texts()) == check(spark, rows.texts())


def test_many_sources_and_clamps(spark):
    data = [(i, "w " * (1 + i * 37 % 50), "en", f"s{i % 7}") for i in range(300)]
    check(spark, data + [(1000, "w " * 30_000, "en", "s6")])


def test_no_rows_and_no_words(spark):
    assert mix(rows.documents(spark, [])).collect() == []
    got = mix(rows.documents(spark, [(1, None, None, None), (1, None, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
