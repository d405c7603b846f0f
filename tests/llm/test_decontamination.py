import rows
from logspark.llm import decontamination
from logspark.llm.decontamination import find_contamination

ITEM = (
    "A train with 120 seats leaves from Hamburg, and after 3 hours Anna counts 45 kg of luggage"
    " while Anna waits for the train with 120 seats near the old bridge"
)
CHANGED = (
    "A train with 80 seats leaves from Lisbon, and after 7 hours Peter counts 12 kg of luggage"
    " while Peter waits for the train with 80 seats near the old bridge"
)
# One name stands for two: no consistent replacement.
MIXED = CHANGED.replace("while Peter", "while Maria")
PLAIN = "words that nobody would write by chance in this very order unless they had seen the question before"


def found(spark, docs, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string, words string, class long")
    got = find_contamination(rows.documents(spark, docs), benchmark)
    return sorted(((r.id, r.item, r.kind) for r in got.collect()), key=str)


def test_kinds(spark):
    items = [(1, ITEM, "x", 1), (2, PLAIN, None, None), (3, None, None, None), (4, "", None, None), (5, "too short", None, None)]
    docs = rows.texts() + [
        (100, f"before it all. {ITEM} and after", "en", "a"),
        (101, f"before it all. {CHANGED} and after", "en", "a"),
        (102, f"before it all. {MIXED} and after", "en", "a"),
        (103, f"BEFORE\n{PLAIN.upper()}", "en", "a"),
        (104, "lead in: " + PLAIN.replace(" ", "  ") + ".", "en", "a"),
        (105, " ".join(PLAIN.split()[:7]), "en", "a"),
        (106, rows.LONG + " " + PLAIN, "en", "a"),
        (None, PLAIN, "en", "a"),
        (None, PLAIN, "en", "a"),
    ]
    assert found(spark, docs, items) == sorted(
        [(100, 1, "copy"), (101, 1, "reparameterised"), (103, 2, "copy"), (104, 2, "copy"), (106, 2, "copy"), (None, 2, "copy")], key=str
    )


def test_repeated_and_short_items(spark):
    items = [(7, PLAIN, None, None), (3, PLAIN, None, None), (None, PLAIN, None, None), (9, "six words stand here as one", None, None)]
    docs = [(1, PLAIN, "en", "a"), (2, "so six words stand here as one window", "en", "a")]
    assert found(spark, docs, items) == [(1, 3, "copy"), (2, 9, "copy")]


def test_empty_tables(spark):
    assert found(spark, [], [(1, PLAIN, None, None)]) == []
    assert found(spark, rows.texts(), []) == []


def test_no_python_in_the_plan(spark):
    benchmark = spark.createDataFrame([(1, PLAIN)], "item_id long, text string")
    plan = find_contamination(rows.documents(spark), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_more_or_less(spark):
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "te") for b in "bcdfghklm"]
    plain = " ".join(words)
    more = " ".join(words[:18] + ["added"] + words[18:])
    less = " ".join(words[:17] + words[18:])
    town = " ".join(words[:17]) + " in {} " + " ".join(words[17:])
    number = " ".join(words[:17]) + " for {} " + " ".join(words[17:])
    items = [(1, plain, None, None), (2, "so " + town.format("New York"), None, None), (3, number.format("120 000") + " end", None, None)]
    docs = [(100, f"before {more} after", "en", "a"), (101, f"before {less} after", "en", "a")]
    got = found(spark, docs, items[:1])
    assert got == [(100, 1, "copy"), (101, 1, "copy")]
    assert found(spark, [(102, "so " + town.format("Paris"), "en", "a")], items[1:2]) == [(102, 2, "reparameterised")]
    assert found(spark, [(103, number.format("7"), "en", "a")], items[2:]) == [(103, 3, "reparameterised")]


def test_names_at_sentence_starts_and_case(spark):
    text = "{0} bought 12 red apples at the small shop. {1} took 9 of them to the old house near the lake. {2} ate the rest."
    named = "when Anna and Peter met Maria near Rome they gave Oskar some bread from Lisbon for Paul"
    slots = "Anna 12 Peter 9 Maria 7 paid Oskar 5"
    items = [(1, text.format("Anna", "Peter", "Maria"), None, None), (2, named, None, None), (3, slots, None, None)]
    docs = [
        (100, "So it goes. " + text.format("Maria", "Oskar", "Paul"), "en", "a"),
        (101, named.lower(), "en", "a"),
        (102, named.upper(), "en", "a"),
        (103, f"we read: {slots} there", "en", "a"),
    ]
    assert found(spark, docs, items) == [(100, 1, "reparameterised"), (101, 2, "copy"), (102, 2, "copy"), (103, 3, "copy")]


def test_short_items_are_found_as_whole_texts(spark):
    items = [(4, "Who was  Ada?", None, None), (2, "who was ada", None, None), (3, "2 + 2", None, None), (5, "!?", None, None)]
    docs = [(100, "WHO was\nAda", "en", "a"), (101, "and who was Ada", "en", "a"), (102, "2+2=", "en", "a"), (103, "!?", "en", "a"), (104, "", "en", "a"), (105, None, "en", "a")]
    assert found(spark, docs, items) == [(100, 2, "copy"), (102, 3, "copy")]


def test_memory_for_long_documents_of_many_matches(spark):
    same = " ".join(["no"] * 60)
    items = [(1, ITEM, None, None), (2, PLAIN, None, None), (3, same, None, None)]
    docs = [
        (100, " ".join([ITEM + "."] * 700), "en", "a"),
        (101, " ".join([PLAIN + "."] * 1000), "en", "a"),
        (102, " ".join(["no"] * 4_000), "en", "a"),
    ]
    assert found(spark, docs, items) == [(100, 1, "copy"), (101, 2, "copy"), (102, 3, "copy")]


def test_texts_are_not_shuffled(spark, monkeypatch):
    name = "spark.sql.autoBroadcastJoinThreshold"
    benchmark = spark.createDataFrame([(1, PLAIN)], "item_id long, text string")
    docs = rows.documents(spark, [(1, f"so {PLAIN}", "en", "a"), (None, f"so {PLAIN}", "en", "a"), (2, "neither", "en", "a"), (None, None, "en", "a")])
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        broadcast = find_contamination(docs, benchmark)
        assert "SortMergeJoin" not in broadcast._jdf.queryExecution().toString()
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
        joined = find_contamination(docs, benchmark)
        assert "SortMergeJoin" in joined._jdf.queryExecution().toString()
        got = [sorted(map(str, df.collect())) for df in (broadcast, joined)]
    finally:
        spark.conf.set(name, before)
    assert got[0] == got[1] and len(got[0]) == 2
