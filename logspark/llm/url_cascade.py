"""URL rules through a Bloom filter cascade.

Level one holds the listed keys, level two the keys of the corpus that level one takes
for listed by mistake, level three the listed keys that level two takes for mistakes, and
so on until no mistake is left. Since all keys of the corpus took part, a lookup is exact
for every one of them, with a few bits a listed key and no join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.tables import staged
from logspark.session import ship_package

# A cascade above this size is not sent to executors; keys are then looked up by a join.
MAX_BYTES = 64 << 20
_MAX_LEVELS = 200
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _positions(h1, h2, level: int, bits: int, hashes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = np.uint64(level + 1) * _STEP
        a, b = _mixed(h1 ^ salt), _mixed(h2 + salt) | np.uint64(1)
        return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint64

    def contains(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(h1), bool)
        at = _positions(h1, h2, level, self.bits, self.hashes)
        hit = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        return hit.all(axis=1)


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys with these hashes are listed; exact for keys of the universe."""
    result, going = np.zeros(len(h1), bool), np.arange(len(h1))
    for number, level in enumerate(levels):
        going = going[level.contains(h1[going], h2[going], number)]
        # Held by an odd number of levels: listed; by an even number: not.
        result[going] = number % 2 == 0
    return result


def _hashes(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def _encode(keys: DataFrame, count: int, rate: float, level: int, max_bytes: int) -> Level | None:
    """A Bloom filter of ``keys`` (``h1``, ``h2``); None if it would be too large."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(count * -math.log2(rate) / math.log(2)))
    if bits > 8 * max_bytes:
        return None

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = _positions(_hashes(batch.h1), _hashes(batch.h2), level, bits, hashes).ravel()
            word = (at >> np.uint64(6)).astype(np.int64)
            value = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pd.DataFrame({"word": word, "value": value})

    rows = (
        keys.select("h1", "h2")
        .mapInPandas(parts, "word long, value long")
        .groupBy("word")
        .agg(F.bit_or("value").alias("value"))
        .toPandas()
    )
    words = np.zeros(-(-bits // 64), np.uint64)
    words[rows.word.to_numpy(np.int64)] = _hashes(rows.value)
    return Level(bits, hashes, words)


def _still(keys: DataFrame, level: Level, number: int) -> DataFrame:
    """Those of ``keys`` that a level holds."""

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[level.contains(_hashes(batch.h1), _hashes(batch.h2), number)]

    return keys.select("h1", "h2").mapInPandas(held, "h1 long, h2 long")


def build(positives: DataFrame, negatives: DataFrame, max_bytes: int = MAX_BYTES) -> list[Level] | None:
    """Levels that tell two disjoint sets of keys (``h1``, ``h2``) apart; None if too large."""
    sides = [positives.select("h1", "h2"), negatives.select("h1", "h2")]
    counts = [s.count() for s in sides]
    # The first level's rate for least total size; later ones halve what is left.
    rate = min(0.5, max(counts[0], 1) / (math.sqrt(2) * max(counts[1], 1)))
    levels: list[Level] = []
    while counts[len(levels) % 2]:
        number = len(levels)
        if number == _MAX_LEVELS:
            raise RuntimeError("two keys share both hashes")
        level = _encode(sides[number % 2], counts[number % 2], rate if not number else 0.5, number, max_bytes)
        if level is None or sum(x.words.nbytes for x in levels) + level.words.nbytes > max_bytes:
            return None
        levels.append(level)
        other = (number + 1) % 2
        sides[other] = staged(_still(sides[other], level, number), "mistakes")
        counts[other] = sides[other].count()
    return levels


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` and for NULL."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys (host suffix and path prefix) that a rule of some shape would have, longest first."""
    labels = F.size(F.split(host, "\\."))
    keys = [
        F.when(
            (labels >= n) & (F.length(path) >= m),
            F.struct(
                (F.length(suffix := F.substring_index(host, ".", -n)) + m).alias("size"),
                F.length(suffix).alias("host_size"),
                F.concat(suffix, F.substring(path, 1, m)).alias("key"),
            ),
        )
        for n, m in shapes
    ]
    ordered = F.sort_array(F.array_compact(F.array(*keys)), asc=False)
    return F.transform(ordered, lambda k: k["key"])


def _h1(key: Column) -> Column:
    return F.xxhash64(key)


def _h2(key: Column) -> Column:
    return F.xxhash64(F.lit(1), key)


def _members(df: DataFrame, keys: str, levels: list[Level], name: str) -> DataFrame:
    """Column ``name``: for each of an array of keys, whether it is listed."""
    sent = df.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("array<boolean>")
    def look(first: pd.Series, second: pd.Series) -> pd.Series:
        sizes = first.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[]] * len(first))
        h1 = np.concatenate([np.asarray(x, np.int64) for x in first]).view(np.uint64)
        h2 = np.concatenate([np.asarray(x, np.int64) for x in second]).view(np.uint64)
        return pd.Series([x.tolist() for x in np.split(listed(sent.value, h1, h2), np.cumsum(sizes)[:-1])])

    column = F.col(keys)
    return df.withColumn(name, look(F.transform(column, _h1), F.transform(column, _h2)))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id: str = "page_id",
    url: str = "url",
    default: str = "allow",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per page: ``id``, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block). A rule fits its host
    and all subdomains if the path starts with the rule's; of several the longest wins
    (of equal length, that with the longer host). Without a rule, ``rule`` is NULL and
    ``verdict`` is ``default``, since the cascade holds no key of the url. A key with both
    actions blocks. NULL urls and urls without ``://`` have empty host and path. Repeated
    rows come out as often as they go in; no rows give no rows; without rules all get
    ``default``. Cascades above ``max_bytes`` are replaced by joins on the keys.
    """
    ship_package(pages.sparkSession)
    rules = rules.where("host is not null and path is not null")
    key_of_rule = F.concat("host", "path")
    block = staged(
        rules.select(key_of_rule.alias("key"), (F.col("action") == "block").alias("block"))
        .groupBy("key")
        .agg(F.max("block").alias("block")),
        "rules",
    )
    # Numbers of labels and path lengths; bounded by the forms of names, not by the list.
    shape = rules.select(F.size(F.split("host", "\\.")), F.length("path")).distinct()
    shapes = sorted((r[0], r[1]) for r in shape.collect())
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path"))
    if not shapes:
        return judged.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = judged.withColumn("keys", _candidates(F.col("host"), F.col("path"), shapes))
    universe = staged(
        keyed.select(F.explode("keys").alias("key"))
        .distinct()
        .join(block, "key", "left")
        .select("key", "block", _h1(F.col("key")).alias("h1"), _h2(F.col("key")).alias("h2")),
        "universe",
    )
    known = build(universe.where("block is not null"), universe.where("block is null"), max_bytes)
    blocked = build(universe.where("block"), universe.where("not block"), max_bytes)
    if known is None or blocked is None:
        return _judge_by_join(keyed, universe.where("block is not null").select("key", "block"), default)
    marked = _members(keyed, "keys", known, "known")
    best = F.element_at(F.filter("keys", lambda k, i: F.get("known", i)), 1)
    first = marked.select("id", "host", "path", F.when(F.exists("known", lambda x: x), best).alias("rule"))
    alone = F.when(F.col("rule").isNull(), F.array().cast("array<string>")).otherwise(F.array("rule"))
    verdicts = _members(first.withColumn("keys", alone), "keys", blocked, "block")
    said = F.when(F.col("rule").isNull(), default).when(F.get("block", F.lit(0)), "block").otherwise("allow")
    return verdicts.select("id", "host", "path", "rule", said.alias("verdict"))


def _judge_by_join(keyed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same result for lists too large to send: each distinct url looks its keys up."""
    urls = keyed.select("host", "path", "keys").distinct()
    found = (
        urls.select("host", "path", F.posexplode("keys").alias("at", "key"))
        .join(rules, "key")
        .groupBy("host", "path")
        .agg(F.min(F.struct("at", "key", "block")).alias("best"))
    )
    said = F.when(F.col("best").isNull(), default).when(F.col("best.block"), "block").otherwise("allow")
    joined = keyed.drop("keys").join(staged(found, "verdicts"), ["host", "path"], "left")
    return joined.select("id", "host", "path", F.col("best.key").alias("rule"), said.alias("verdict"))
