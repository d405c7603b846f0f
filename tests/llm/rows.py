"""Awkward rows for every operator: NULLs, empty and long texts, ties, repeats, clashing names."""

LONG = " ".join(f"word{i % 977} " + ("Haus" if i % 7 else "house") for i in range(20_000))

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id long, fp long, component string, row string, size long, h string, key string, digest string, "
    "language string, target double, words long, gone string, lines string"
)

_TEXTS = [
    (1, "The cat sat on the mat and looked at the dog", "en", "a"),
    (2, "The cat sat on the mat and looked at the dog", "en", "b"),
    (3, "the CAT sat on the mat and looked at the dog", "en", None),
    (4, "", "en", "a"),
    (5, None, None, "b"),
    (6, " \t\n\x0b\x0c\r ", None, "c"),
    (7, "12 34 56", "de", "c"),
    (8, LONG, "de", "a"),
    (9, LONG, "de", "d"),
    (None, "no id here at all", "en", "d"),
    (None, "no id here at all", "en", "d"),
    (10, "gleiche Zeile\nzweite Zeile\ndritte Zeile\nvierte Zeile", "de", None),
    (11, "davor\ngleiche Zeile\nzweite Zeile\ndritte Zeile\nvierte Zeile\ndanach", "de", "a"),
    (11, "davor\ngleiche Zeile\nzweite Zeile\ndritte Zeile\nvierte Zeile\ndanach", "de", "a"),
    (12, "\n\n\n\n\n", None, ""),
    (13, "é\u00a0ü \U0001f600 x", "fr", "a"),
]


def documents(spark, rows=_TEXTS):
    extra = (7, 7, "x", "x", 7, "x", "x", "x", "x", 7.0, 7, "x", "x")
    full = [(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def texts():
    return list(_TEXTS)
