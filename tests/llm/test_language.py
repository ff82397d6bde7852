"""Language ID: held-out accuracy, the parts of the model, odd rows."""

import zlib

import numpy as np
import pytest

from gaitworks.llm import language

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")


@pytest.fixture(scope="module")
def model(documents):
    return language.fit(documents)


def test_held_out_rows_are_told_right(documents, model):
    found = language.identify(documents.filter(language.held_out("doc_id")), model).collect()
    assert len(found) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) >= 0.98
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in found)


def test_the_prediction_depends_on_the_text_alone(spark, documents, model):
    texts = [r["text"] for r in documents.limit(40).collect()]
    one = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, score int")
    two = spark.createDataFrame([(None, t, None, 2) for t in texts], "doc_id long, text string, lang string, score int")
    a, b = (sorted(tuple(r) for r in language.identify(x, model).select("text", "lang_pred", "score").collect()) for x in (one, two))
    assert a == b
    assert language.identify(one, model).columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_odd_texts(spark, model):
    texts = [None, "", " 12 !? ", "\u0301", "the " * 400_000, "x", "é", "中文"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(rows, model).collect()}
    assert [found[i] for i in range(4)] == [("und", 0.0)] * 4
    assert found[4][0] == "en"
    assert all(found[i][0] in model.languages and 0 < found[i][1] <= 1 for i in range(4, 8))


def test_long_texts_are_counted_in_parts(monkeypatch):
    text = "Der schnelle Fuchs, 12 Mal über den Zaun! " * 50
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "_PART", 37)
    assert (language.ngram_counts(text) == whole).all()


@pytest.mark.parametrize("rows", [[], [(1, None, "en"), (2, "words", None)], [(1, "only one", "en"), (2, "one only", "en"), (3, "one", "en")]])
def test_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert language.identify(docs, model).count() == len(rows)


def test_weights_are_sparse_and_training_is_repeatable(documents, model):
    assert (model.weights == 0).mean() > 0.5
    again = language.fit(documents)
    assert again.languages == model.languages and again.temperature == model.temperature
    assert (again.weights == model.weights).all()


def test_temperature_recovers_a_scale():
    draw = np.random.default_rng(3)
    logits = draw.normal(size=(4000, 3))
    share = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.array([draw.choice(3, p=p) for p in share])
    assert abs(language.temperature(logits * 4.0, labels) - 4.0) < 0.5


def test_many_languages_are_all_learned(spark, monkeypatch):
    """Each of 600 labels writes with letters of its own; held-out texts get theirs."""
    letters = [chr(0x4E00 + i) for i in range(1200)]
    rows = [(i, " ".join(letters[2 * (i % 600) + (i + j) % 2] * 3 for j in range(12)), f"l{i % 600:03d}") for i in range(600 * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == sorted({r[2] for r in rows})
    found = language.identify(docs.filter(language.held_out("doc_id")), model).collect()
    assert len(found) > 600 and np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.9
    monkeypatch.setattr(language, "LANGUAGES", 599)
    with pytest.raises(ValueError, match="more than 599 languages"):
        language.fit(docs)
