"""Removal of repeated runs of lines by winnowing over line hashes.

Of every window of ``run`` consecutive lines the first line with the least hash is a
fingerprint, so two equal windows always choose one at the same place. Places of one
fingerprint are kept once, however many windows chose it, and those whose hash stands at
one place only end the search. The others are extended both ways, over the lines beside them,
to the ends of the windows that chose them; of equal windows the first place in document order
stays, and all others are joined to it. Lines of later windows go; where windows overlap or
meet, whole runs go. A run of ``run`` lines or more is thus found wherever it begins, and no
pair of occurrences is ever made: a run in a million documents costs a million rows. Runs of
fewer lines count if they have ``words`` words; they are found in the same way, length by
length.

Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.tables import Steps, staged

RUN = 3
# Words from which a run of fewer lines counts.
WORDS = 50
# Marks digests of texts too short for a run of lines.
_SHORT = "short:"
_WORD = r"[^\x20\x09-\x0D]+"


def _words(text: Column | str) -> Column:
    return F.regexp_count(text, F.lit(_WORD))


def _fingerprints(documents: DataFrame, run: int, words: int = 0) -> DataFrame:
    """Lines that are the first least one of some window of ``run`` lines, once each.

    ``at`` is the line, ``mark`` its hash, ``check`` a second one, ``near`` the hashes of the
    ``run - 1`` lines on either side and its own, ``before`` how many lines each window that
    chose it has before it. Only windows of ``words`` words or more choose, if that is not 0.
    """
    # The one-row generator keeps the split from being done again for each line. No lambda
    # comes after the second one, so the arrays are not copied for each line.
    split = F.split("text", "\n", -1)
    line = F.struct(
        F.transform(split, lambda x: F.xxhash64(x)).alias("hashes"),
        (F.transform(split, lambda x: F.xxhash64(F.lit(1), x)) if run == 1 else F.lit(None)).alias("checks"),
        (F.transform(split, _words) if words else F.lit(None)).alias("words"),
    )
    lines = documents.select("id", "digest", F.explode(F.array(line)).alias("l")).select("id", "digest", "l.*")
    lines = lines.where(F.size("hashes") >= run)
    each = lines.select("*", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1)).alias("at"))
    own = F.get("hashes", F.col("at"))

    def chosen(before: int) -> Column:
        first = F.col("at") - before
        here = (first >= 0) & (first + run <= F.size("hashes"))
        for i in range(run):
            if i != before:
                other = F.get("hashes", first + i)
                here &= (own < other) if i < before else (own <= other)
        if words:
            here &= sum((F.get("words", first + i) for i in range(run)), F.lit(0)) >= words
        return F.when(here, F.lit(before))

    found = each.select(
        "id",
        "digest",
        F.col("at").cast("int").alias("at"),
        own.alias("mark"),
        (F.get("checks", F.col("at")) if run == 1 else F.lit(0)).cast("long").alias("check"),
        F.array(*[F.get("hashes", F.col("at") + i) for i in range(1 - run, run)]).alias("near"),
        F.array_compact(F.array(*map(chosen, range(run)))).alias("before"),
    )
    return found.where(F.size("before") > 0)


def _later_windows(documents: DataFrame, run: int, words: int = 0) -> DataFrame:
    """``id``, ``digest``, ``at`` and ``run`` of windows that stand earlier too."""
    steps = Steps(documents.sparkSession)
    prints = steps.write(_fingerprints(documents, run, words), "fingerprints")
    marks = steps.write(prints.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "marks")
    # From the shared line both ways, to the ends of each window that chose it.
    each = prints.join(marks, "mark", "left_semi").select("*", F.explode("before").alias("lead"))
    extended = F.slice("near", run - F.col("lead"), run)
    windows = steps.write(
        each.select(
            "id", "digest", (F.col("at") - F.col("lead")).alias("at"), "mark", F.xxhash64("check", "lead", extended).alias("rest")
        ),
        "extended",
        ["fingerprints", "marks"],
    )
    place = F.struct(F.col("id").isNull().alias("last"), "id", "digest", "at")
    first = windows.groupBy("mark", "rest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = steps.write(first.select("mark", "rest", "first"), "runs")
    later = windows.join(first, ["mark", "rest"]).where(place > F.col("first"))
    later = staged(later.select("id", "digest", "at", F.lit(run).alias("run")), "later")
    steps.drop("extended", "runs")
    return later


def repeated_lines(documents: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """Numbers of the lines to remove, per distinct ``id`` and ``digest``, as array ``gone``.

    ``documents`` has ``id``, ``digest`` (of the text), ``text``. A window is later than an
    equal one by id (NULL last), digest and line number. Windows of fewer lines than ``run``
    count from ``words`` words (None: never).
    """
    later = _later_windows(documents, run)
    if words is not None:
        for fewer in range(1, run):
            later = later.union(_later_windows(documents, fewer, max(words, 1)))
    covered = F.sequence(F.col("at"), F.col("at") + F.col("run") - 1)
    return later.groupBy("id", "digest").agg(
        F.array_distinct(F.flatten(F.collect_list(covered))).alias("gone")
    )


def deduplicate_lines(
    documents: DataFrame, *, id: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = WORDS
) -> DataFrame:
    """``documents`` with repeated runs removed from ``text``; all rows and columns stay.

    A run of ``run`` or more consecutive lines that also stands earlier (in a document of
    smaller id, or further up in the same) goes with its line ends; runs may overlap. So does
    a run of fewer lines that has ``words`` words or more (what blanks part; None turns this
    off). Texts of fewer than ``run`` lines that are copies of each other are treated alike: all lose what
    the one of the least id loses, so a later step for whole copies finds them. Lines are what
    newlines part, so blank lines count. NULL texts stay NULL; texts of fewer lines stay
    as they are; a text that repeats wholly becomes empty. Documents with NULL ids come
    last. Of rows with equal id and text one keeps it; which of them is decided by the
    other columns' hash. Columns of any other name pass through. No rows give no rows.
    """
    content, digest = F.col(f"`{text}`"), F.sha2(F.col(f"`{text}`"), 256)
    if words is not None:
        short = (F.size(F.split(content, "\n", -1)) < run) & (_words(content) >= words)
        digest = F.when(short, F.concat(F.lit(_SHORT), digest)).otherwise(digest)
    key = [F.col(f"`{id}`").alias("id"), digest.alias("digest")]
    rest_of_row = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text], F.lit(0)).alias("row")
    keyed = documents.select(*key, rest_of_row, F.split(content, "\n", -1).alias("lines"))
    is_short = F.coalesce(F.col("digest").startswith(_SHORT), F.lit(False))
    keyed = keyed.withColumn("id", F.when(~is_short, F.col("id")))
    own = documents.select(*key, content.alias("text")).where("text is not null")
    if words is not None:
        least = F.min(F.struct(F.col("id").isNull().alias("last"), "id")).alias("least")
        once = own.where(is_short).groupBy("digest").agg(least, F.first("text").alias("text"))
        own = own.where(~is_short).union(once.select("least.id", "digest", "text"))
    gone = repeated_lines(own, run, words)
    gone = staged(gone.select(F.when(~is_short, F.col("id")).alias("id"), "digest", "gone"), "repeats")
    copies = staged(
        keyed.groupBy("id", "digest").agg(F.count("*").alias("copies")).where("copies > 1 and digest is not null").where(~is_short),
        "copies",
    )
    rest = gone.join(
        copies, gone.id.eqNullSafe(copies.id) & (gone.digest == copies.digest), "full"
    ).select(
        F.coalesce(gone.id, copies.id).alias("i"),
        F.coalesce(gone.digest, copies.digest).alias("d"),
        "gone",
        "copies",
    )
    removals = staged(rest, "removals")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
    joined = keyed.join(removals, same, "left").drop("i", "d")
    one = _without(joined.where("copies is null"), documents.columns, text, F.col("gone"))
    # Rows with equal id and text: all lines of the later ones are repeats of the first. These
    # texts are a table of their own, so its size on disk decides whether all rows are shuffled
    # for them.
    repeated = staged(removals.where("copies is not null"), "copied")
    hashed = [F.col("row")[c] for c, kind in documents.dtypes if c != text and "map<" not in kind]
    place = F.struct(F.xxhash64(F.lit(0), *hashed).alias("hash"), F.spark_partition_id().alias("part"))
    many = staged(keyed.join(repeated, same).drop("i", "d").select("*", place.alias("place")), "copied-rows")
    # The first is one of the rows of least hash that one task wrote, so a text in any number of
    # rows is not brought together.
    least = many.groupBy(F.col("id").alias("i"), F.col("digest").alias("d")).agg(F.min("place").alias("first"))
    many = many.join(staged(least, "copied-first"), same).drop("i", "d")
    ahead, size = F.col("place") == F.col("first"), F.size("lines")
    number = F.row_number().over(Window.partitionBy("id", "digest").orderBy("place"))
    every = F.when(size >= run, F.sequence(F.lit(0), size - 1))
    many = many.where(ahead).withColumn("number", number).unionByName(many.where(~ahead).withColumn("number", F.lit(2)))
    return one.union(_without(many, documents.columns, text, F.when(F.col("number") == 1, F.col("gone")).otherwise(every)))


def _without(joined: DataFrame, columns: list[str], text: str, gone: Column) -> DataFrame:
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone_here")
    left = F.transform(kept, lambda i: F.get("lines", i))
    new = F.array_join(F.when(F.col("gone_here").isNull(), F.col("lines")).otherwise(left), "\n")
    return joined.withColumn("gone_here", gone).select(
        *[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in columns]
    )
