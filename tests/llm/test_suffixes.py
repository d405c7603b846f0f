import hashlib
import random
from collections import Counter

import rows
from logspark.llm.queries import QUERIES
from logspark.llm.suffix_dedup import LENGTH, remove_repeats, runs_of_strings


def brute(texts):
    counts = Counter(b[i : i + LENGTH] for b in texts for i in range(len(b) - LENGTH + 1))
    result = []
    for b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - LENGTH + 1):
            if counts[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = [True] * LENGTH
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        result.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return result


def check(spark, data):
    got = remove_repeats(rows.documents(spark, data)).collect()
    found = [(str(r.id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got]
    want = [(str(d[0]), *x) for d, x in zip(data, brute([(d[1] or "").encode() for d in data]))]
    assert sorted(found) == sorted(want)


def test_awkward_rows(spark):
    short = [r for r in rows.texts() if len(r[1] or "") < 1000]
    check(spark, short + [(20, rows.LONG[:3000], "en", "a"), (21, rows.LONG[1000:5000], "en", "a")])


def test_planted_repeats(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = word(2500)
    data = [(i, word(rng.randint(0, 900)), "en", "s") for i in range(10)]
    for i in range(10, 40):
        a = rng.randint(0, 1500)
        data.append((i, word(rng.randint(0, 400)) + shared[a : a + rng.randint(350, 1200)] + word(rng.randint(0, 400)), "en", "s"))
    data += [(50, "x" * 1500, "en", "s"), (51, "ab" * 450 + word(300) + "ab" * 210, "en", "s")]
    data += [(52, shared, "en", "s"), (52, shared, "en", "s"), (None, shared[:401], "en", "s")]
    data += [(53, "y" * 399, "en", "s"), (54, "y" * 399, "en", "s"), (55, "z" * 400, "en", "s")]
    check(spark, data)


def test_query_judges_planted_passages_by_their_bytes(spark, tmp_path):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghé") for _ in range(n))
    passage = lambda words, letters: " ".join(word(letters) for _ in range(words))
    # 55 words each; only the second has the bytes of a repeat.
    short, long = passage(55, 4), passage(55, 7)
    assert len(short.encode()) < LENGTH <= len(long.encode())
    planted = {"clean": "", "short": short, "long": long}
    kinds = [kind for kind in planted for _ in range(4)]
    data = [(i, f"{passage(60, 6)}\n{planted[kind]}\n{passage(60, 6)}", "en", "s") for i, kind in enumerate(kinds)]
    rows.documents(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op4_suffixes"](spark, str(tmp_path)).orderBy("doc_id").collect()
    want = brute([text.encode() for _, text, *_ in data])
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in found] == [x[:3] for x in want]
    assert [r.kept_sha256 for r in found] == [hashlib.sha256(x[3]).hexdigest() for x in want]
    assert [r.n_removed >= len(long.encode()) for r in found] == [kind == "long" for kind in kinds]
    assert [r.n_removed == 0 for r in found] == [kind != "long" for kind in kinds]


def test_no_rows(spark):
    assert remove_repeats(rows.documents(spark, [])).collect() == []


def test_runs_cover_all_starts_once():
    text = random.Random(2).randbytes(5000) + b"a" * 3000
    starts = [p for first, last, *_ in runs_of_strings(text) for p in range(first, last + 1)]
    assert starts == list(range(len(text) - LENGTH + 1))
    held = {(text[p : p + LENGTH], a - p) for f, q, a, *_ in runs_of_strings(text) for p in range(f, q + 1)}
    assert len(held) == len({x for x, _ in held})
