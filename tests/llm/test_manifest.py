import hashlib

import pytest
from pyspark.sql import functions as F
from rows import documents, texts

from logspark.llm.manifest import climb, descend, folded, leaf, manifest, siblings


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, fanout):
    """Root, and each leaf's steps (digests before, digests after), level by level."""
    proofs, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + fanout] for i in range(0, len(digests), fanout)]
        for n, i in enumerate(at):
            run = runs[i // fanout]
            proofs[n].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        digests, at = [H("".join(r)) for r in runs], [i // fanout for i in at]
    return digests[0], proofs


def brute(rows, fanout):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, lang, leaf)."""
    groups = {}
    for i, lang, digest in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, digest, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in order]
    root, above = tree([t[0] for t in trees], fanout)
    out = []
    for g, (subroot, proofs), top in zip(order, trees, above, strict=True):
        for (_, _, digest, i), proof in zip(sorted(groups[g], key=lambda x: x[:3]), proofs, strict=True):
            out.append((i, g, digest, subroot, root, tuple(proof + top)))
    return sorted(out, key=repr)


def proved(df, fanout, levels):
    digest = leaf(F.col("doc_id"), F.col("lang"), F.col("text"))
    out = manifest(df, digest, fanout=fanout, levels=levels)
    rows = out.select("*", folded("leaf").alias("again"), siblings().alias("told")).collect()
    assert all(r.again == r.root for r in rows)
    assert all(r.told == "".join(b + a for b, a in r.proof) for r in rows)
    return sorted(
        ((r.doc_id, r.lang, r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in rows), key=repr
    )


@pytest.mark.parametrize("fanout", [2, 3, 5])
@pytest.mark.parametrize("n", [1, 2, 3, 8, 17, 100])
def test_sweeps(n, fanout):
    digests = [H(str(i)) for i in range(n)]
    height = 0
    while fanout**height < n:
        height += 1
    root, proofs = tree(digests, fanout)
    for _, _, children in climb(digests, 0, height, fanout):
        last = children
    if n > 1:
        assert H("".join(last)) == root
    for got, want in zip(descend(digests, 0, height, fanout, ()), proofs, strict=True):
        steps = []
        while got:
            step, got = got
            steps.append(step)
        assert steps == want


@pytest.mark.parametrize(("fanout", "levels"), [(2, 12), (2, 2), (3, 1)])
def test_awkward_rows(spark, fanout, levels):
    want = brute([(i, lang, leaf_of(i, lang, t)) for i, t, lang, _ in texts()], fanout)
    assert proved(documents(spark), fanout, levels) == want


def test_blocks_and_hot_group(spark):
    rows = [(i % 150, f"t{i % 7}", "en" if i % 3 else f"l{i % 11}", "s") for i in range(400)]
    want = brute([(i, lang, leaf_of(i, lang, t)) for i, t, lang, _ in rows], 2)
    assert proved(documents(spark, rows), 2, 3) == want


def test_tampering_shows(spark):
    rows = [(i, f"t{i}", "en", "s") for i in range(20)]
    other = leaf(F.col("doc_id"), F.when(F.col("doc_id") == 5, "changed").otherwise(F.col("text")))
    out = manifest(documents(spark, rows), leaf(F.col("doc_id"), F.col("text")), given=other)
    bad = out.where(folded("given") != F.col("root")).collect()
    assert [r.doc_id for r in bad] == [5]


def test_empty_table(spark):
    assert proved(documents(spark, []), 2, 12) == []
