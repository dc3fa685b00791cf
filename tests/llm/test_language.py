import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from runloom.llm import language
from runloom.llm.queries import QUERIES


def test_bundles_equal_the_definition():
    texts = ["Aé, b!", "", None, "ab ab 1 abc", "12 !"]
    got, has = language.text_vectors(texts)
    assert has.tolist() == [True, False, False, True, False]
    for t, v in zip(texts, got):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        padded = " " + " ".join(words) + " "
        expect = np.zeros(language.DIMS)
        for i in range(len(padded) - 2):
            a, b, c = (language.letter_vector(ord(x)).astype(float) for x in padded[i: i + 3])
            expect += np.roll(a, 2) * np.roll(b, 1) * c
        if words:
            assert np.allclose(v, expect)


def test_long_texts_are_read_whole(monkeypatch):
    text = "some words and others " * 50
    whole = language.text_vectors([text])[0]
    monkeypatch.setattr(language, "CELLS", 3)
    assert np.allclose(language.text_vectors(["x", text])[0][1], whole[0])
    odd = ["", "a", " b", "!!! " * 90, "ab " * 70 + "…" * 130 + "cd", "ÉΣ" * 150, "x" + " " * 205 + "y z", text + "İstanbul ΑΣ ΑΣ."]
    expect, has = language.text_vectors([*odd, text])
    for chars in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language, "PIECE_CHARS", chars)
        got, seen = language.text_vectors([*odd, text])
        assert (got == expect).all() and (seen == has).all()


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op9_language"](spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    met = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    held = met[met.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_odd_rows(odd_docs, no_docs):
    prototypes = language.learn_languages(odd_docs, F.lit(True))
    assert set(prototypes) == {"en", "fr"}
    got = language.predict_language(odd_docs, prototypes)
    assert got.columns == [c for c in odd_docs.columns if c != "score"] + ["lang_pred", "score"]
    rows = {r.doc_id: r for r in got.collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 8))
    assert rows[1].lang_pred == "en" and rows[10].lang_pred == "fr" and got.count() == odd_docs.count()
    assert language.learn_languages(no_docs, F.lit(True)) == {}
    assert {r.lang_pred for r in language.predict_language(odd_docs, {}).collect()} == {"und"}
    assert language.predict_language(no_docs, prototypes).count() == 0


def test_columns_of_any_name(spark):
    docs = spark.sql("SELECT 'some words' AS text, 1 AS `a.b`, map('k', 2) AS m, 3 AS _text, 4 AS lang_pred, 5 AS c0")
    got = language.predict_language(docs, {"en": language.text_vectors(["some words"])[0][0]})
    assert got.columns == ["text", "a.b", "m", "_text", "c0", "lang_pred", "score"]
    assert tuple(got.first())[:6] == ("some words", 1, {"k": 2}, 3, 5, "en")
