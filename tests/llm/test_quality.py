"""Quality classifier: held-out accuracy, the parts of the model, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitworks.llm import quality
from gaitworks.llm.language import held_out

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return quality.fit(*tables)


def test_held_out_labels_are_told_right(tables, model):
    docs, labels = tables
    scored = quality.classify(docs.filter(held_out("doc_id")), model).join(labels, "doc_id").collect()
    assert len(scored) > 500 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in scored)
    right = {label: [(r["score"] >= 0.3) == label for r in scored if r["quality"] == label] for label in (0, 1)}
    assert np.mean(right[1]) >= 0.99 and np.mean(right[0]) >= 0.85
    # calibrated: the mean score is the share of good ones, and so it is among the unsure
    assert abs(np.mean([r["score"] for r in scored]) - np.mean([r["quality"] for r in scored])) < 0.03


def test_the_score_depends_on_the_text_alone(spark, tables, model):
    texts = [r["text"] for r in tables[0].limit(40).collect()]
    one = spark.createDataFrame([(i, t, 1, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, quality int, score double")
    two = spark.createDataFrame([(None, t, 0, None) for t in texts * 2], "doc_id long, text string, quality int, SCORE double")
    a, b = ({(r["text"], r["score"]) for r in quality.classify(x, model).select("text", "score").collect()} for x in (one, two))
    assert a == b
    assert quality.classify(one, model).columns == ["doc_id", "text", "quality", "score"]
    assert quality.classify(two, model).count() == 80


def test_odd_texts(spark, model):
    texts = [None, "", " ", "x", "é\x00", "中文", "good words and more. " * 200_000, "Er Er Er Er " * 300]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in quality.classify(rows, model).collect()}
    assert found[0] == found[1] and all(0 <= x <= 1 for x in found.values())
    assert found[7] < 0.3
    assert quality.classify(rows.limit(0), model).collect() == []


def test_fitting_is_repeatable(tables, model):
    docs, labels = tables
    again = quality.fit(docs.repartition(7, F.rand(1)), labels.repartition(3))
    assert again.dictionaries == model.dictionaries and (again.weights == model.weights).all()


def test_held_out_rows_and_other_labels_are_not_learned_from(spark, tables):
    docs, labels = tables
    other = labels.withColumn("quality", F.when(held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    more = other.unionByName(other.limit(50).withColumn("quality", F.lit(None).cast("int"))).unionByName(other.limit(50).withColumn("quality", F.lit(2)))
    a, b = quality.fit(docs, labels), quality.fit(docs, more.unionByName(other))
    assert a.dictionaries == b.dictionaries and (a.weights == b.weights).all()


@pytest.mark.parametrize(
    "rows,score",
    [([], 0.5), ([(1, "a", None)], 0.5), ([(1, "a b", 1), (2, None, 1)], 1.0), ([(1, "a", 0)], 0.0), ([(1, "a b", 1), (2, "c", 0)], None)],
)
def test_few_labels(spark, rows, score):
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    found = [r["score"] for r in quality.classify(table, model).collect()]
    assert len(found) == len(rows) and all(0 <= x <= 1 and score in (None, x) for x in found)


def test_repeated_documents_count_once(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 40) for i in range(40)] + [(3, "zzz")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, quality int")
    once = quality.fit(docs.filter("text <> 'zzz'"), labels)
    many = quality.fit(docs, labels)
    assert once.dictionaries == many.dictionaries and np.array_equal(once.weights, many.weights)


def test_pieces_cover_the_whole_text():
    text = bytes(range(256)) * 40
    assert b"".join(quality.pieces(text, 1000)) == text
    few = quality.pieces(text, 3)
    assert len(few) <= 3 and few[0] == text[:512] and all(x in text for x in few)
    assert quality.pieces(b"", 3) == []


def test_calibration_finds_known_weights():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(20_000, 2)) * [1.0, 50.0]
    labels = (draw.random(20_000) < 1 / (1 + np.exp(-(0.5 + x @ [2.0, -0.03])))).astype(float)
    found = quality.calibrate(x, labels, np.ones(len(x)))
    assert np.allclose(found, [0.5, 2.0, -0.03], atol=0.1)


def test_calibration_of_parted_classes_ends():
    x = np.concatenate([np.full((50, 1), -1.0), np.full((50, 1), 1.0)])
    found = quality.calibrate(x, np.repeat([0.0, 1.0], 50), np.ones(100))
    assert np.isfinite(found).all() and found[1] > 1
