"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts per language and hash bucket add up in Spark; only the table of languages by
buckets reaches the driver and is broadcast as log probabilities. A batch of texts is one
long array of bucket numbers with text boundaries (a sparse matrix row by row), scored by
numpy without a loop over texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.tables import staged
from logspark.session import ship_package

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
# About as many labelled documents are learned from; if there are more, a hash of the id
# chooses. Prediction always covers all rows.
MAX_TRAINING_DOCUMENTS = 200_000
# Bounds the table that is broadcast.
MAX_LANGUAGES = 256
# Characters scored at once; longer texts are counted in pieces of about this length.
_PIECE = 1 << 18
# Characters before a piece of a text that its first n-grams begin in.
_CARRIED = 64


@lru_cache(maxsize=1)
def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and its lower case."""
    characters = [chr(i) for i in range(0x110000)]
    letters = np.array([c.isalpha() for c in characters])
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in characters], np.uint32)
    return letters, lower


def _cut(text: str) -> Iterator[tuple[str, int]]:
    """A text in pieces that end behind a word, and how much of each was in the one before.

    What is carried over ends with a letter and what follows it, which is all that n-grams
    of three characters can reach back to; those that end in it are counted once.
    """
    start, carried = 0, 0
    while start < len(text):
        end = start + _PIECE
        while end < len(text) and not (text[end - 2].isalpha() and not text[end - 1].isalpha()):
            end += 1
        yield text[start - carried : end], carried
        start, carried = end, min(_CARRIED, end)


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Lists of texts, long ones cut, of some ``_PIECE`` characters together."""
    rows, parts, heads, size = [], [], [], 0
    for row, text in enumerate(texts):
        for part, carried in _cut(text or ""):
            rows.append(row)
            parts.append(part)
            heads.append(carried)
            size += len(part)
            if size >= _PIECE:
                yield rows, parts, heads
                rows, parts, heads, size = [], [], [], 0
    if rows:
        yield rows, parts, heads


def _grams(rows: list[int], parts: list[str], heads: list[int], orders: Sequence[int], buckets: int):
    """For each order, rows and buckets of all n-grams; and the rows that have a letter.

    Letters are lower-cased, everything between two words counts as one space.
    """
    letters, lower = _character_tables()
    text = " ".join(parts) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) + 1 for p in parts])
    owner, part = np.repeat(np.array(rows), lengths), np.repeat(np.arange(len(parts)), lengths)
    carried = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.repeat(np.array(heads), lengths)
    letter = letters[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    with_letter = np.unique(owner[letter])
    points = np.where(letter, lower[points], np.uint32(32))[keep]
    owner, part, carried = owner[keep], part[keep], carried[keep]
    found = []
    for order in orders:
        if len(points) < order:
            continue
        n = len(points) - order + 1
        mixed = np.full(n, order, np.uint32)
        for i in range(order):
            mixed = mixed * np.uint32(0x01000193) + points[i : i + n]
        mixed *= np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        whole = (part[:n] == part[order - 1 :]) & ~carried[order - 1 :]
        found.append((owner[:n][whole], (mixed % np.uint32(buckets))[whole]))
    return found, with_letter


def count_grams(texts: Sequence[str | None], orders=ORDERS, buckets=BUCKETS) -> np.ndarray:
    """Counts of all n-grams of some texts together."""
    counts = np.zeros(buckets, np.int64)
    for rows, parts, heads in _pieces(texts):
        for _, bucket in _grams(rows, parts, heads, orders, buckets)[0]:
            counts += np.bincount(bucket, minlength=buckets)
    return counts


@dataclass(frozen=True)
class Model:
    """Log probabilities of languages and of buckets in each language."""

    languages: tuple[str, ...]  # by code point
    prior: np.ndarray  # languages
    weights: np.ndarray  # buckets x languages
    orders: tuple[int, ...]

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability; ``und`` and 0 without a letter or a model."""
        scores = np.tile(self.prior, (len(texts), 1))
        known = np.zeros(len(texts), bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        for rows, parts, heads in _pieces(texts):
            found, with_letter = _grams(rows, parts, heads, self.orders, len(self.weights))
            known[with_letter] = True
            for owner, bucket in found:
                if len(owner):
                    starts = np.flatnonzero(np.diff(owner, prepend=-1))
                    sums = np.add.reduceat(self.weights[bucket], starts, axis=0)
                    scores[owner[starts]] += sums
        best = scores.argmax(axis=1)
        top = scores.max(axis=1, keepdims=True)
        share = 1.0 / np.exp(scores - top).sum(axis=1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, np.where(known, share, 0.0)


def fit(
    labelled: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    orders: Sequence[int] = ORDERS,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    max_documents: int = MAX_TRAINING_DOCUMENTS,
) -> Model:
    """Learn from rows that have an id, a text and a language."""
    ship_package(labelled.sparkSession)
    usable = labelled.select(
        F.col(id).alias("id"), F.col(text).alias("text"), F.col(language).alias("language")
    ).where("id is not null and text is not null and language is not null")
    total = usable.count()
    if total > max_documents:
        share = max_documents / total
        usable = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}

        def rows():
            for name, table in tables.items():
                bucket = np.flatnonzero(table)
                yield pd.DataFrame({"language": name, "bucket": bucket, "n": table[bucket]})
                yield pd.DataFrame({"language": [name], "bucket": [-1], "n": [documents[name]]})

        for batch in batches:
            for name, group in batch.groupby("language"):
                table = count_grams(group["text"].tolist(), orders, buckets)
                tables[name] = tables[name] + table if name in tables else table
                documents[name] = documents.get(name, 0) + len(group)
            if len(tables) > MAX_LANGUAGES:
                yield from rows()
                tables.clear(), documents.clear()
        yield from rows()

    summed = staged(
        usable.select("language", "text")
        .mapInPandas(counts, "language string, bucket long, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n")),
        "grams",
    )
    if summed.select("language").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = summed.toPandas()
    names = tuple(sorted(rows.language.unique()))
    table = np.zeros((buckets, len(names)))
    prior = np.zeros(len(names))
    at = rows.language.map({n: i for i, n in enumerate(names)}).to_numpy(np.int64)
    bucket, n = rows.bucket.to_numpy(np.int64), rows.n.to_numpy(np.int64)
    table[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    prior[at[bucket < 0]] = n[bucket < 0]
    table += smoothing
    if names:
        prior = np.log(prior / prior.sum())
    return Model(names, prior, np.log(table / table.sum(axis=0)), tuple(orders))


def with_language(df: DataFrame, model: Model, text: str = "text", name: str = "language") -> DataFrame:
    """``df`` with struct ``name`` (``language``, ``score``) predicted from ``text`` alone."""
    ship_package(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = sent.value.predict(texts.tolist())
            yield pd.DataFrame({"language": names, "score": scores})

    return df.withColumn(name, predict(F.col(text)))


def held_out(id: Column) -> Column:
    """Whether a document is kept from training: one third by a checksum of its id."""
    return F.coalesce(F.crc32(id.cast("string")) % 3 == 1, F.lit(False))


def identify_languages(documents: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    Learns from the documents that are not held out and have an id, a text and a ``lang``.
    ``score`` is the posterior probability. Texts that are NULL or have no letter, and all
    texts if nothing could be learned, are ``und`` with score 0. Of languages with equal
    scores the least name counts. Texts above 262,144 characters are scored in pieces that
    end behind words; every n-gram counts once, across pieces too. Repeated rows come out as often as they go in;
    other columns are ignored; no rows give no rows.
    """
    model = fit(documents.where(~held_out(F.col("doc_id"))), **options)
    own = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = with_language(own, model, "text", "_predicted")
    return scored.select(
        "doc_id", "held_out",
        F.col("_predicted.language").alias("lang_pred"), F.col("_predicted.score").alias("score"),
    )
