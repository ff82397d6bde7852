"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text;
whatever is not a letter counts as a space. Document frequencies come from all
rows that may be learned from. Weights are trained by follow-the-regularised-
leader with an elastic net on a bounded sample of these rows, in one task, and
probabilities are calibrated by a temperature on a part of the sample that the
weights have not seen. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import prepared, quoted

#: Hashed features; n-gram lengths.
BITS, LENGTHS = 15, (1, 2, 3)
SIZE = 1 << BITS
#: Labelled rows that the weights are trained and the temperature fitted on, at most (about; over all languages).
SAMPLE = 4000
#: Languages that one model can hold: with more labels ``fit`` is an error, as the weights of a language take memory in every task.
LANGUAGES = 1000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
_PART = 1 << 18
_K = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str) -> np.ndarray | None:
    """How often each feature occurs in the whole text; none if it has no letter."""
    table, total, any_letter = _letter_table(), np.zeros(SIZE, np.int64), False
    low = text.lower()
    for at in range(0, len(low), _PART):
        part = low[at : at + _PART + LENGTHS[-1] - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = table[codes]
        any_letter = any_letter or bool(letter[:_PART].any())
        codes = np.where(letter, codes, np.uint32(32))
        scaled = np.zeros(len(codes), np.uint32)
        some = np.zeros(len(codes), bool)
        for length in LENGTHS:
            count = min(len(codes) - length + 1, _PART)
            if count <= 0:
                break
            shifted = slice(length - 1, length - 1 + count)
            scaled = scaled[:count] * np.uint32(31) + codes[shifted] * _K[length - 1]
            some = some[:count] | letter[shifted]
            mixed = (scaled ^ (scaled >> np.uint32(15))) * _K[0]
            total += np.bincount(mixed[some] >> np.uint32(32 - BITS), minlength=SIZE)
    return total if any_letter else None


def _sparse(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    counts = ngram_counts(text) if text else None
    if counts is None:
        return None
    at = np.flatnonzero(counts)
    return at, counts[at]


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[at]
    norm = np.sqrt((values**2).sum())
    return values / norm if norm > 0 else values


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for value in batch.column(0):
            found = _sparse(value.as_py())
            rows += 1
            if found is not None:
                seen[found[0]] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], names=["feature", "rows"]
    )


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "fit", "mark", "at", "counts"]
    for batch in batches:
        found = [_sparse(value.as_py()) for value in batch.column(3)]
        keep = [i for i, f in enumerate(found) if f is not None]
        arrays = [batch.column(i).take(pa.array(keep, pa.int64())) for i in range(3)]
        at = pa.array([found[i][0].astype(np.uint16 if BITS <= 16 else np.uint32).tobytes() for i in keep], pa.binary())
        counts = pa.array([found[i][1].astype(np.uint32).tobytes() for i in keep], pa.binary())
        yield pa.RecordBatch.from_arrays([*arrays, at, counts], names=names)


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> np.ndarray:
    """Weights (features by classes, most of them zero) of follow-the-regularised-leader over the examples in order."""
    z, n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, at, values in examples:
            here, squares = z[at], n[at]
            w = weights(here, squares)
            logits = values @ w
            share = np.exp(logits - logits.max())
            share /= share.sum()
            share[label] -= 1.0
            gradient = values[:, None] * share[None, :]
            more = squares + gradient**2
            z[at] = here + gradient - (np.sqrt(more) - np.sqrt(squares)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        scaled = logits / np.exp(t)
        top = scaled.max(1)
        return float((top + np.log(np.exp(scaled - top[:, None]).sum(1)) - scaled[np.arange(len(labels)), labels]).mean())

    low, high, ratio = -5.0, 5.0, (np.sqrt(5.0) - 1.0) / 2.0
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2.0))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        found = _sparse(text)
        if found is None or not self.languages:
            return "und", 0.0
        logits = _weighted(*found, self.idf) @ self.weights[found[0]] / self.temperature
        share = np.exp(logits - logits.max())
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum())


def held_out(doc_id: str | Column) -> Column:
    """Rows that are never learned from: CRC-32 of the doc_id's decimal text divisible by 5 (of empty text for null)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the texts and labels of all rows that are neither held out nor without a label.

    Every label is learned; more than ``LANGUAGES`` of them are an error. A table without labels gives a model that
    answers ``und``.
    """
    spark = prepared(docs.sparkSession)
    mark = F.xxhash64(quoted(doc_id), quoted(text))
    rows = docs.filter(~held_out(quoted(doc_id)) & quoted(lang).isNotNull())
    rows = rows.select(quoted(lang).cast("string").alias("lang"), quoted(text).alias("text"), mark.alias("mark"))

    counted = rows.select("text").mapInArrow(_frequencies, "feature long, rows long").groupBy("feature").agg(F.sum("rows").alias("rows"))
    table = counted.toArrow()
    seen, total = np.zeros(SIZE), 0
    for feature, count in zip(table["feature"].to_pylist(), table["rows"].to_pylist()):
        if feature < 0:
            total = count
        else:
            seen[feature] = count
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0

    counts = rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages among the labels; a model holds weights for each of them in memory")
    languages = sorted(row["lang"] for row in counts)
    if not languages:
        return Model([], idf, np.zeros((SIZE, 0)), 1.0)
    quota = max(SAMPLE // len(languages), 5)
    share = F.element_at(F.create_map(*[F.lit(x) for row in sorted(counts) for x in (row["lang"], min(1.0, quota / row["count"]))]), F.col("lang"))
    chosen = rows.filter(F.pmod("mark", F.lit(1 << 30)) / float(1 << 30) < share)
    part = chosen.select("lang", (F.pmod(F.xxhash64("mark"), F.lit(5)) > 0).alias("fit"), "mark", "text")
    features = part.mapInArrow(_sample_features, "lang string, fit boolean, mark long, at binary, counts binary")
    held = spark.sparkContext.broadcast((languages, idf))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, idf = held.value
        place = {name: i for i, name in enumerate(names)}
        fitted, rest = [], []
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["at"], np.uint16 if BITS <= 16 else np.uint32).astype(np.int64)
                values = _weighted(at, np.frombuffer(row["counts"], np.uint32), idf)
                (fitted if row["fit"] else rest).append((place[row["lang"]], at, values))
        weights = train(fitted, len(names))
        logits = np.array([values @ weights[at] for _, at, values in rest]).reshape(len(rest), len(names))
        heat = temperature(logits, np.array([label for label, _, _ in rest], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()]), pa.array([heat])], names=["weights", "heat"])

    learned = features.repartition(1).sortWithinPartitions("mark", "lang").mapInArrow(learn, "weights binary, heat double").first()
    if learned is None:  # no chosen text has a letter
        return Model(languages, idf, np.zeros((SIZE, len(languages))), 1.0)
    weights = np.frombuffer(learned["weights"], np.float32).reshape(SIZE, len(languages))
    return Model(languages, idf, weights, learned["heat"])


def identify(docs: DataFrame, model: Model, text: str = "text", results: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Every row with the predicted language (``und`` if the text is null or has no letter) and its probability (then 0).

    Empty and very long texts are read whole. Columns of the results' names are replaced.
    """
    spark = prepared(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in results]
    source = docs.select(quoted(text), *[quoted(c) for c in kept])
    schema = docs.select(*[quoted(c) for c in kept]).schema.add(results[0], "string").add(results[1], "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(value.as_py()) for value in batch.column(0)]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=schema.names)

    return source.mapInArrow(predict, schema)
