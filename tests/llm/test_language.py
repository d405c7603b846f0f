import zlib

import numpy as np

import rows
from logspark.llm import language
from logspark.llm.language import BUCKETS, count_grams, fit, identify_languages, with_language

EN = "the house and the garden were quiet in the evening "
DE = "das haus und der garten waren ruhig an diesem abend "


def test_awkward_rows(spark):
    data = rows.texts() + [(100 + i, (EN, DE)[i % 2] * (1 + i % 3), ("en", "de")[i % 2], "s") for i in range(40)]
    got = identify_languages(rows.documents(spark, data)).collect()
    assert len(got) == len(data)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    named = {r.doc_id: r.lang_pred for r in got}
    assert [named[i] for i in (4, 5, 6, 7, 12)] == ["und"] * 5
    assert all(named[100 + i] == ("en", "de")[i % 2] for i in range(40))
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}


def test_scores_are_naive_bayes(spark):
    data = [(i, (EN, DE)[i % 2], ("en", "de")[i % 2], "s") for i in range(9)]
    model = fit(rows.documents(spark, data))
    assert model.languages == ("de", "en")
    tables = np.stack([count_grams([t for _, t, lang, _ in data if lang == x]) for x in model.languages]) + 0.5
    log = np.log(tables / tables.sum(axis=1, keepdims=True))
    text = "the Evening, 12 GARTEN"
    scores = np.log(np.array([4, 5]) / 9) + log @ count_grams([text])
    want = np.exp(scores - scores.max())
    names, share = model.predict(["", text, None])
    assert names == ["und", model.languages[int(want.argmax())], "und"]
    assert abs(share[1] - (want / want.sum()).max()) < 1e-9 and count_grams([text]).shape == (BUCKETS,)


def test_batches_do_not_matter(spark):
    data = [(i, (EN, DE)[i % 2], ("en", "de")[i % 2], "s") for i in range(9)]
    model = fit(rows.documents(spark, data))
    texts = [None, EN, "", rows.LONG * 3, DE, "x", "é"]
    together = list(zip(*model.predict(texts)))
    assert [tuple(next(zip(*model.predict([t])))) for t in texts] == [tuple(x) for x in together]


def test_no_rows_and_nothing_to_learn(spark):
    assert identify_languages(rows.documents(spark, [])).collect() == []
    got = identify_languages(rows.documents(spark, [(1, "some text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_sample_bound(spark):
    data = [(i, (EN, DE)[i % 2], ("en", "de")[i % 2], "s") for i in range(200)]
    model = fit(rows.documents(spark, data), max_documents=60)
    assert set(with_language(rows.documents(spark, data), model, name="p").select("p.language").toPandas().language) == {"en", "de"}


def test_pieces_lose_no_ngram(monkeypatch):
    text = "Straße, 12 the  -- quiet é " * 40 + "x" * 500 + "1" * 300 + " end of it"
    whole = [count_grams([text], orders=(n,)) for n in (1, 2, 3)]
    for piece in (3, 10, 64, 200):
        monkeypatch.setattr(language, "_PIECE", piece)
        for n, want in zip((1, 2, 3), whole):
            assert (count_grams([text, "a", text], orders=(n,)) == 2 * want + count_grams(["a"], orders=(n,))).all()
