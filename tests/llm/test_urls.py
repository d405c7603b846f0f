import re

import pytest

from logspark.llm.url_cascade import build, judge_urls, listed

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b", "", "block"), (None, "/", "block"), ("x", None, "allow"),
]
URLS = [
    "http://Example.ORG/es/1", "https://sub.example.org/es/?q", "http://example.org/es", "http://example.org/en/12#x",
    "http://myexample.org/es/1", "http://org/", "http://org", "http://x.com/fr/?u=http://y.org/", "http://com/de/",
    "http://com.com/de/z", "http://x.de/fr/", "x.org/es/", "", None, "://", "http://?a/b", "http://a.b", "http://c.a.b?x",
    "http://É.org/Ä", "http://a\nb.org/es/\n", "http://" + "l." * 300 + "org/" + "p" * 5000, "http://example.org/es/1",
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(h) + len(p), len(h), h + p, a) for h, p, a in RULES
        if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_rules(spark, max_bytes):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS[:3]])], "page_id long, url string, key string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules, max_bytes=max_bytes).collect()}
    assert got == {i: plain(u) for i, u in enumerate([*URLS, *URLS[:3]])}


def test_no_rows_and_no_rules(spark):
    pages = spark.createDataFrame([(None, "http://a.org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    assert judge_urls(pages.where("false"), rules).collect() == []
    assert [tuple(r) for r in judge_urls(pages, rules.where("false")).collect()] == [(None, "a.org", "/", None, "allow")]


@pytest.mark.parametrize("positives, negatives", [(300, 5000), (2000, 50), (0, 100), (100, 0)])
def test_cascade_is_exact_over_its_universe(spark, positives, negatives):
    import numpy as np

    keys = spark.range(positives + negatives).selectExpr("id", "xxhash64(id) AS h1", "xxhash64(1, id) AS h2")
    levels = build(keys.where(f"id < {positives}"), keys.where(f"id >= {positives}"))
    rows = keys.toPandas()
    hashes = [rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2")]
    assert (listed(levels, *hashes) == (rows.id < positives).to_numpy()).all()
