import random

import pytest
import rows
from logspark.llm.line_dedup import _fingerprints, deduplicate_lines


def brute(data, run=3):
    """Kept text of each (id, text), ids with NULL last and copies after the first."""
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0))
    seen, kept = set(), [None] * len(data)
    for i in order:
        if data[i][1] is None:
            continue
        lines = data[i][1].split("\n")
        gone = set()
        for at in range(len(lines) - run + 1):
            window = tuple(lines[at : at + run])
            if window in seen:
                gone.update(range(at, at + run))
            seen.add(window)
        kept[i] = "\n".join(x for at, x in enumerate(lines) if at not in gone)
    return kept


def check(spark, data):
    docs = rows.documents(spark, data)
    got = deduplicate_lines(docs)
    assert got.columns == docs.columns
    want = [(d[0], k) for d, k in zip(data, brute(data))]
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(want, key=key)


def test_awkward_rows(spark):
    check(spark, rows.texts())


def test_random_lines(spark):
    rng = random.Random(3)
    data = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 25))), "en", "s") for i in range(60)]
    check(spark, data)


def brute_words(data, run, words):
    """Kept text of each (id, text), ids distinct; runs of fewer lines count from ``words`` words."""
    order = sorted(range(len(data)), key=lambda i: data[i][0])
    seen, kept, done = set(), [None] * len(data), {}
    for i in order:
        lines = data[i][1].split("\n")
        short = len(lines) < run and len(data[i][1].split()) >= words
        if short and data[i][1] in done:
            kept[i] = done[data[i][1]]
            continue
        gone = set()
        for n in range(1, run + 1):
            for at in range(len(lines) - n + 1):
                window = tuple(lines[at : at + n])
                if n < run and len(" ".join(window).split()) < words:
                    continue
                if window in seen:
                    gone.update(range(at, at + n))
                seen.add(window)
        kept[i] = "\n".join(x for at, x in enumerate(lines) if at not in gone)
        if short:
            done[data[i][1]] = kept[i]
    return kept


@pytest.mark.parametrize("run, words", [(3, 4), (3, 6), (2, 3), (5, 9), (1, 50)])
def test_random_lines_of_words(spark, run, words):
    rng = random.Random(run * 100 + words)
    line = lambda: " ".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
    data = [(i, "\n".join(line() for _ in range(rng.choice([1, 1, 2, 3, 8, 20]))), "en", "s") for i in range(80)]
    rng.shuffle(data)
    got = deduplicate_lines(rows.documents(spark, data), run=run, words=words).collect()
    want = [(d[0], k) for d, k in zip(data, brute_words(data, run, words))]
    assert sorted((r.doc_id, r.text) for r in got) == sorted(want)


def test_fingerprints_are_places(spark):
    """Half of all lines or so choose themselves; a line is one place however many windows chose it."""
    docs = spark.createDataFrame([(1, "d", "\n".join(str(i) for i in range(300)))], "id int, digest string, text string")
    found = _fingerprints(docs, 3).collect()
    assert len({r.at for r in found}) == len(found) < 200
    assert sorted(r.at - b for r in found for b in r.before) == list(range(298))


def test_no_rows(spark):
    assert deduplicate_lines(rows.documents(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = deduplicate_lines(rows.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_passages_on_few_lines(spark):
    one, half = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(25))
    less = " ".join(f"u{i}" for i in range(49))
    data = [
        (1, f"a\n{one}\nb", "en", "s"),
        (2, f"c\n{one}\nd", "en", "s"),
        (3, f"e\n{half}\n{half}\nf", "en", "s"),
        (4, f"g\n{half}\n{half}\nh", "en", "s"),
        (5, f"i\n{less}\nj", "en", "s"),
        (6, f"k\n{less}\nl", "en", "s"),
        (7, f"{one} x", "en", "s"),
        # Whole copies stay alike, for the step that finds those.
        (8, f"{one} x", "en", "s"),
        (8, f"{one} x", "en", "s"),
        (9, one, "en", "s"),
        (9, one, "en", "s"),
        (None, f"m\n{one} x\nn", "en", "s"),
    ]
    got = sorted(((r.doc_id, r.text) for r in deduplicate_lines(rows.documents(spark, data)).collect()), key=str)
    kept = [d[1] for d in data]
    kept[1], kept[3], kept[9], kept[10], kept[11] = "c\nd", "g\nh", "", "", "m\nn"
    assert got == sorted(((d[0], k) for d, k in zip(data, kept)), key=str)
    off = deduplicate_lines(rows.documents(spark, data), words=None).collect()
    assert sorted(((r.doc_id, r.text) for r in off), key=str) == sorted(((d[0], d[1]) for d in data), key=str)
