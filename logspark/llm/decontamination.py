"""Benchmark decontamination by templates.

Texts are canonicalised: numbers, names and units become typed placeholders, other words
are lower-cased. Windows of template words of the benchmark are hash-joined with those of
the documents. Neighbouring placeholders of one type are one slot, so a value may have any
number of words. Where enough windows of an item lie in one document at one offset, or at
offsets some words apart, the values behind the placeholders are compared slot by slot: equal values are a copy, and
values replaced the same way throughout a re-parameterised question.

A first look finds the documents that can hold enough windows at all. Of every window's words
that are no values, the longest neighbouring two (or the longest one, where none are
neighbours) must stand in a document in the same way; they are looked up in its plain words,
and templates are made of the documents that have any.

Only built-in functions are used. What is made of the benchmark is broadcast if it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.tables import staged

WINDOW = 8
MIN_SHARE = 0.5
# Words by which windows of one occurrence may be out of place: put in, left out, replaced by more or fewer.
BAND = 8
# An item with fewer words that are no placeholders cannot be told from chance inside a text.
MIN_LITERALS = 5
# Bytes of the benchmark's windows, and of the keys of documents looked at, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
# Bytes of a key in a broadcast table.
_KEY_BYTES = 64
# Between words of the first look at a document; the same around words of letters as in templates.
_BETWEEN = r"[^\p{L}\p{M}\p{N}%°]+"
_LETTERS = r"^[\p{L}\p{M}]+$"

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
# A capital at the start of a sentence: a name or not.
START = "\ue003"
MARKS = NUMBER + NAME + UNIT + START
# Units taken for such after a number.
UNITS = (
    "%|°c|°f|kg|mg|g|km/h|km|cm|mm|m|ml|l|s|ms|min|h|kb|mb|gb|tb|hz|khz|mhz|ghz|w|kw|kwh|v|usd|eur|gbp"
    "|percent|degrees|dollars?|euros?|pounds?|cents?|kilograms?|grams?|tons?|kilometers?|meters?|metres?"
    "|centimeters?|miles?|feet|foot|inch(?:es)?|liters?|litres?|seconds?|minutes?|hours?|days?|weeks?"
    "|months?|years?"
)


def _marked(text: Column) -> Column:
    """Words parted by single spaces; numbers, names and units with a mark before them."""
    plain = F.translate(text, MARKS, " " * len(MARKS))
    plain = F.regexp_replace(plain, r"[\x00-\x20]+", " ")
    # A capital after a word or comma is a name; at the start of a sentence it may be one.
    named = F.regexp_replace(plain, r"(?<=[\p{Ll}\p{N},;:] )(?=\p{Lu})", NAME)
    named = F.regexp_replace(named, f"(?<![\\p{{L}}\\p{{N}}{NAME}])(?=\\p{{Lu}})", START)
    lower = F.lower(named)
    numbered = F.when(
        lower.rlike("[0-9]"),
        F.regexp_replace(
            F.regexp_replace(lower, r"(?<![\p{L}\p{N}])([0-9]+(?:[.,][0-9]+)*)", f" {NUMBER}$1"),
            f"({NUMBER}[0-9.,]*[0-9]) ?({UNITS})(?![\\p{{L}}\\p{{N}}])",
            f"$1 {UNIT}$2 ",
        ),
    ).otherwise(lower)
    return F.trim(
        F.regexp_replace(
            numbered, f"(?:[^\\p{{L}}\\p{{M}}\\p{{N}}{MARKS}.,%°/]|[.,/](?![0-9])|(?<![0-9])[.,/])+", " "
        )
    )


def _slots_joined(marked: Column) -> Column:
    for kind in (NUMBER, NAME):
        # \G goes on where the last match ended, inside the same slot.
        joined = F.regexp_replace(marked, f"({kind}[^ ]*|\\G(?!^)[^ ]+) {kind}", "$1_")
        marked = F.when(marked.rlike(f"{kind}[^ ]* {kind}"), joined).otherwise(marked)
    return marked


def _tokens(df: DataFrame, *keys: str) -> DataFrame:
    """Three readings of column ``text``: ``words`` (marked), ``template`` (values taken out).

    0: sentences start with plain words; 1: with names, if capitalised; 2: all are plain
    words. ``codes`` are hashes of the template's words.
    """
    marked = df.select(*keys, F.explode(F.array(_marked(F.col("text")))).alias("m")).where("m <> ''")
    readings = [
        _slots_joined(F.translate("m", START, "")),
        _slots_joined(F.translate("m", START, NAME)),
        F.translate("m", MARKS, ""),
    ]
    reading = F.explode(F.array(*[F.struct(F.lit(i).alias("reading"), m.alias("m")) for i, m in enumerate(readings)]))
    each = marked.select(*keys, F.xxhash64(readings[2]).alias("same"), reading.alias("r"))
    template = F.split(F.regexp_replace("r.m", f"([{NUMBER}{NAME}{UNIT}])[^ ]*", "$1"), " ")
    # A one-row generator, so that the arrays are made once and not for each window.
    arrays = F.struct(
        F.split("r.m", " ").alias("words"), template.alias("template"), F.transform(template, lambda x: F.xxhash64(x)).alias("codes")
    )
    each = each.select(*keys, "same", "r.reading", F.explode(F.array(arrays)).alias("t"))
    return each.select(*keys, "same", "reading", "t.words", "t.template", "t.codes")


def _windows(tokens: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    sizes = F.array(*[F.lit(n) for n in lengths])
    each = tokens if len(lengths) == 1 else tokens.withColumn("n", F.explode(sizes))
    if len(lengths) == 1:
        each = each.withColumn("n", F.lit(lengths[0]))
    each = each.where(F.size("template") >= F.col("n"))
    at = F.explode(F.sequence(F.lit(0), F.size("template") - F.col("n")))
    return each.select(*keys, "reading", "words", "codes", "n", at.alias("at"))


def _hash(start: Column) -> Column:
    return F.xxhash64("reading", "n", F.slice("codes", start + 1, F.col("n")))


def _rarest(part: Column) -> Column:
    """``length`` and ``hash`` of a window's longest two neighbours that are words of letters.

    Of the longest word and with length 0, if there are no such neighbours.
    """
    def longest(found: Column) -> Column:
        return F.array_max(F.filter(found, lambda x: x.isNotNull()))

    following = F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(1)))
    two = F.zip_with(
        part, following,
        lambda a, b: F.when(
            a.rlike(_LETTERS) & b.rlike(_LETTERS),
            F.struct((F.length(a) + F.length(b)).alias("length"), F.xxhash64(a, b).alias("hash")),
        ),
    )
    one = F.transform(
        part, lambda a: F.when(a.rlike(_LETTERS), F.struct(F.length(a).alias("length"), F.xxhash64(a).alias("hash")))
    )
    alone = longest(one)["hash"]
    return F.coalesce(longest(two), F.when(alone.isNotNull(), F.struct(F.lit(0).alias("length"), alone.alias("hash"))))


def _worth_a_look(own: DataFrame, known: DataFrame, totals: DataFrame, min_share: float, small: bool) -> DataFrame:
    """``id`` and ``digest`` of documents that can hold enough windows of some item.

    A document without any of ``total - least + 1`` windows of an item has fewer than
    ``least``, so that many are looked for: those with the longest words.
    """
    order = Window.partitionBy("class").orderBy(F.desc("rarest.length"), "rarest.hash", "pos")
    least = F.ceil(F.col("total") * min_share)
    asked = known.select("class", "pos", "rarest", F.row_number().over(order).alias("nth")).join(totals, "class")
    asked = asked.where(F.col("nth") <= F.col("total") - least + 1)
    rarest = staged(asked.select(F.col("rarest.hash").alias("h")).distinct(), "rarest")
    plain = F.lower(F.translate("text", MARKS, " " * len(MARKS)))
    split = F.explode(F.array(F.split(plain, _BETWEEN))).alias("w")
    words = own.select("id", "digest", split)
    at = F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("at")
    first, second = F.get("w", F.col("at")), F.get("w", F.col("at") + 1)
    hashes = F.explode(F.array(F.xxhash64(first, second), F.xxhash64(first)))
    held = words.select("id", "digest", "w", at).select("id", "digest", hashes.alias("h"))
    if small:
        held = held.join(F.broadcast(rarest), "h", "left_semi")
    else:
        held = held.distinct().join(rarest, "h", "left_semi")
    return staged(held.select("id", "digest").distinct(), "looked-at")


def _only(own: DataFrame, looked: DataFrame) -> DataFrame:
    """The documents of ``own`` that ``looked`` names.

    Their texts stay where they are, as long as a table of the digests can be broadcast. A digest
    is enough there, since equal texts are looked at alike.
    """
    if looked.count() * _KEY_BYTES <= BROADCAST_BYTES:
        return own.join(F.broadcast(looked.select("digest")), "digest", "left_semi")
    looked = looked.select(F.col("id").alias("i"), F.col("digest").alias("d"))
    return own.join(looked, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Benchmark items in documents: ``id``, ``digest``, ``item``, ``share``, ``kind``.

    One row for each document and each class of items with equal words, whatever their case;
    ``item`` is the class's least id (NULL if all are). ``share`` is the largest part of the
    item's windows found at one offset or at offsets up to ``BAND`` words apart, at least ``min_share``. ``kind`` is ``copy`` or
    ``reparameterised``; where a value of the item is replaced by several, nothing is
    reported. ``digest`` hashes the document's text, as ids may repeat. Items shorter than
    ``window`` are one window. Items are searched by their plain words, and by templates in
    which a capital that begins a sentence is a name and in which it is none, each only with
    ``MIN_LITERALS`` words beside placeholders. Items that have fewer words in all are found
    where they are a document's whole words. NULL and empty texts match nothing. Windows of which less than half are
    such words are not searched. Repeated rows are reported once. Other columns are
    ignored; empty tables give no rows.
    """
    given = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    items = _tokens(given, "item")
    literal = F.size(F.filter("template", lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    items = (
        items.withColumn("item", F.min("item").over(Window.partitionBy("same")))
        .dropDuplicates(["reading", "words"])
        .where(literal >= MIN_LITERALS)
        .withColumn("class", F.xxhash64("reading", "words"))
        .withColumn("n", F.least(F.lit(window), F.size("template")))
    )
    items = staged(items, "items")
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())
    start = F.explode(F.sequence(F.lit(0), F.size("template") - F.col("n")))
    cut = items.select("class", "same", "item", "reading", "words", "template", "codes", "n", start.alias("pos"))
    part = F.slice("template", F.col("pos") + 1, F.col("n"))
    enough = F.size(F.filter(part, lambda x: ~x.isin(NUMBER, NAME, UNIT))) * 2 >= F.col("n")
    known = staged(
        cut.where(enough).select(
            _hash(F.col("pos")).alias("h"),
            F.col("n").alias("known_n"),
            "class",
            "same",
            "item",
            "pos",
            F.slice("words", F.col("pos") + 1, F.col("n")).alias("asked"),
            _rarest(part).alias("rarest"),
        ),
        "windows",
    )
    totals = known.groupBy("class").agg(F.count("*").alias("total"))
    held = known.agg(F.sum(F.length(F.array_join("asked", " ")) + 100).alias("bytes"), F.count_if(F.col("rarest").isNull()).alias("bare")).first()
    small = (held["bytes"] or 0) <= BROADCAST_BYTES
    own = documents.select(
        F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text")
    )
    if not held["bare"]:
        own = _only(own, _worth_a_look(own, known, totals, min_share, small))
    tokens = _tokens(own, "id", "digest")
    cut = _windows(tokens, lengths or [window], "id", "digest").withColumn("key", _hash(F.col("at")))
    said = F.slice("words", F.col("at") + 1, F.col("n"))
    # A task keeps all rows that a document's windows make in the join until it is through with them.
    # So these rows hold a window's words, not the document's, and equal windows of an item are one.
    known = known.groupBy("h", "known_n", "class", "same", "item", "asked").agg(F.collect_list("pos").alias("at_pos"))
    if small:
        known, totals = F.broadcast(known), F.broadcast(totals)
    else:
        cut = cut.select("id", "digest", "n", "at", "key", said.alias("said"))
    found = cut.join(known, (F.col("key") == F.col("h")) & (F.col("n") == F.col("known_n")))
    if small:
        found = found.select("id", "digest", "class", "same", "item", "at_pos", "at", "asked", F.explode(F.array(said)).alias("said"))
    slots = F.filter(
        F.zip_with("asked", "said", lambda a, b: F.struct(a.alias("asked"), b.alias("said"))),
        lambda s: F.substring(s["asked"], 1, 1).isin(NUMBER, NAME, UNIT),
    )
    at_offset = (
        found.select("id", "digest", "class", "same", "item", "at_pos", "at", slots.alias("slots"))
        .select("*", F.explode("at_pos").alias("pos"))
        .withColumn("offset", F.col("at") - F.col("pos"))
        .groupBy("id", "digest", "class", "same", "item", "offset")
        .agg(F.collect_set("pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    )
    # Each offset alone, and every span of BAND + 1 offsets that holds it.
    starts = F.sequence(F.col("offset") - BAND, F.col("offset"))
    spans = F.transform(starts, lambda x: F.struct(F.lit(None).cast("int").alias("alone"), x.alias("start")))
    alone = F.array(F.struct(F.col("offset").alias("alone"), F.col("offset").alias("start")))
    aligned = (
        at_offset.withColumn("span", F.explode(F.concat(alone, spans)))
        .groupBy("id", "digest", "class", "same", "item", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"),
            F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
        )
        .join(totals, "class")
        .withColumn("share", F.col("found") / F.col("total"))
        .where(F.col("share") >= min_share)
    )
    asked = F.transform("slots", lambda s: s["asked"])
    consistent = F.size(F.array_distinct(asked)) == F.size("slots")
    same = F.forall("slots", lambda s: s["asked"] == s["said"])
    inside = (
        aligned.where(consistent)
        .groupBy("id", "digest", "same", "item")
        # The reading of the largest share says the kind.
        .agg(F.max(F.struct("share", same.alias("copy"))).alias("best"))
        .select(
            "id", "digest", "item", "best.share",
            F.when(F.col("best.copy"), "copy").otherwise("reparameterised").alias("kind"),
        )
    )
    short = _short_items(given)
    return inside if short.isEmpty() else inside.unionByName(_whole_texts(documents, short, id, text))


def _plain_words(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def _short_items(given: DataFrame) -> DataFrame:
    """Items of fewer than ``MIN_LITERALS`` words: ``asked``, and the least ``item`` of those with equal ones."""
    told = given.select("item", _plain_words("text").alias("asked")).where("asked <> ''")
    told = told.where(F.size(F.split("asked", " ")) < MIN_LITERALS)
    return staged(told.groupBy("asked").agg(F.min("item").alias("item")), "short-items")


def _whole_texts(documents: DataFrame, short: DataFrame, id: str, text: str) -> DataFrame:
    """Documents whose words are those of a short item."""
    own = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("digest"), _plain_words(F.col(text)).alias("said"))
    found = own.join(short, F.col("said") == F.col("asked")).select("id", "digest", "item").distinct()
    return found.select("*", F.lit(1.0).alias("share"), F.lit("copy").alias("kind"))
