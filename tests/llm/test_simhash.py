import re

import pytest
import xxhash
from pyspark.sql import functions as F

import rows
from logspark.llm.components import connected_components
from logspark.llm.simhash import fingerprint, near_duplicates, near_pairs


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    bits = [sum(h >> b & 1 for h in hashes) * 2 > len(hashes) for b in range(64)]
    return sum(1 << b for b, on in enumerate(bits) if on)


def brute(keyed):
    """Least id of the group of each (id, fingerprint), by comparing all pairs."""
    label = list(range(len(keyed)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(keyed)):
        for j in range(i):
            if bin(keyed[i][1] ^ keyed[j][1]).count("1") <= 3:
                label[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(keyed):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted((key, fp, least.get(root(i))) for i, (key, fp) in enumerate(keyed) if key is not None)


@pytest.mark.parametrize("text", [t for _, t, _, _ in rows.texts()] + ["A", "a b", "É É É É", "x " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text) % (1 << 64) == plain(text)


def test_awkward_rows(spark):
    got = near_duplicates(rows.documents(spark)).collect()
    assert len(got) == len(rows.texts())
    keyed = [(i, plain(t)) for i, t, _, _ in rows.texts()]
    assert sorted((r.id, r.fp % (1 << 64), r.component) for r in got if r.id is not None) == brute(keyed)
    assert [r.component for r in got if r.id is None] == [None, None]


def test_no_rows(spark):
    assert near_duplicates(rows.documents(spark, [])).collect() == []


@pytest.mark.parametrize("distance, segments", [(3, 2), (3, 4), (5, 2)])
def test_pairs_against_all(spark, distance, segments):
    import random

    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(12)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centre for _ in range(12)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values | {0, (1 << 64) - 1, 1 << 31, 1 << 32}]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {frozenset(r) for r in near_pairs(df, distance, segments).collect()}
    want = {
        frozenset((a, b)) for a in signed for b in signed
        if a < b and bin((a ^ b) % (1 << 64)).count("1") <= distance
    }
    assert got == want and want


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 100), (300, 200), (5, 5), (None, 7)]
    got = connected_components(spark.createDataFrame(chain, "u long, v long"))
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(61)} | {(100, 100), (200, 100), (300, 100)}
    assert got.where(F.col("node").isNull()).count() == 0
