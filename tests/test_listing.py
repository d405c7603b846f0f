import glob
import os
import random

import pytest

from logspark.sources.listing import underscored_files, without_braces


def tree(root, seed=4, n=60):
    """A random tree with ordinary, underscored and dotted names."""
    rng = random.Random(seed)
    names = ["a", "b", "_c", ".d", "e1", "_f=2", "g=3"]
    for i in range(n):
        folder = os.path.join(root, *[rng.choice(names) for _ in range(rng.randrange(4))])
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, rng.choice(["", "_", "."]) + f"f{i}"), "w") as out:
            out.write("x" * i)


def hidden(parts):
    return any(p.startswith("_") and "=" not in p for p in parts) and not any(p.startswith(".") for p in parts)


def wanted(roots):
    """Files below folders, or named themselves, with a hidden part and no dotted one."""
    out = {}
    for root in roots:
        if os.path.isfile(root):
            if hidden([os.path.basename(root)]):
                out[root] = os.path.getsize(root)
            continue
        for folder, _, files in os.walk(root):
            for f in files:
                path = os.path.join(folder, f)
                if hidden(os.path.relpath(path, root).split("/")):
                    out[path] = os.path.getsize(path)
    return out


def found(spark, roots, **options):
    rows = underscored_files(spark, roots, **options).collect()
    assert len({r.path for r in rows}) == len(rows)
    return {r.path.removeprefix("file:"): r["size"] for r in rows}


@pytest.mark.parametrize("folders_per_task", [1_000, 1])
def test_walk_of_a_folder(spark, tmp_path, folders_per_task):
    tree(tmp_path)
    want = wanted([str(tmp_path)])
    assert len(want) > 10
    assert found(spark, [str(tmp_path)], folders_per_task=folders_per_task) == want


@pytest.mark.parametrize("pattern", ["*", "[a-e]*", "*/*", "_*", "?/_c", "{a,_c}", "{a/b,b/*}", "e?/*", "nothing*", "*/f*"])
def test_wildcard_roots(spark, tmp_path, pattern):
    tree(tmp_path, seed=11, n=90)
    roots = [r for p in without_braces(pattern) for r in glob.glob(str(tmp_path / p))]
    assert found(spark, [str(tmp_path / pattern)]) == wanted(roots)


def test_braces():
    assert without_braces("a{b,c{d,e}}f{g,}") == ["abfg", "abf", "acdfg", "acdf", "acefg", "acef"]
    assert without_braces(r"a\{b,c") == [r"a\{b,c"]
    with pytest.raises(ValueError):
        without_braces("{a")
