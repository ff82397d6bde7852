"""Quality classifier: which of two zstandard dictionaries, of good and of bad texts, helps more to compress a text.

A bounded sample of labelled texts is cut into pieces, and a dictionary is
trained from the pieces of each class. A text is compressed in blocks with
either dictionary. The difference of both sizes over their sum is the evidence;
a logistic function, fitted on sampled texts that the dictionaries have not
seen, turns it into a probability. It also sees how far the text shrinks at all
(texts that repeat themselves need no dictionary) and its length (short texts
give little evidence). Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import prepared, quoted
from gaitworks.llm.language import held_out

#: Labelled documents that are learned from, at most (about), for each of the two labels.
SAMPLE = 4000
#: Tenths of the sample that the dictionaries are made of; the rest calibrates.
BUILD_TENTHS = 6
#: Pieces that a dictionary is made of, at most (about); bytes of a piece and of a dictionary.
PIECES, PIECE_BYTES, DICTIONARY_BYTES = 8000, 512, 110_000
#: Texts are compressed in blocks of so many bytes, so that in a long text the dictionary counts all along.
BLOCK_BYTES = 2048
LEVEL = 3
RIDGE = 1.0


def pieces(text: bytes, count: int) -> list[bytes]:
    """At most ``count`` pieces, evenly spread over the whole text."""
    starts = range(0, len(text), PIECE_BYTES)
    step = max(1, -(-len(starts) // count))
    return [text[at : at + PIECE_BYTES] for at in starts[::step]]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples to train one, the samples themselves; of none, nothing."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    made = zstandard.ZstdCompressionDict(content)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=made, **plain)


class Model:
    """Two dictionaries (bad, good) and the weights of the calibration; ``share`` is the answer without either."""

    def __init__(self, dictionaries: tuple[bytes, bytes], weights: np.ndarray | None = None, share: float = 0.5):
        self.dictionaries, self.weights, self.share = dictionaries, weights, share
        self._compressors: list[zstandard.ZstdCompressor] | None = None

    def __getstate__(self):
        return self.dictionaries, self.weights, self.share

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def sizes(self, text: bytes) -> tuple[int, int]:
        if self._compressors is None:
            self._compressors = [_compressor(x) for x in self.dictionaries]
        blocks = [text[at : at + BLOCK_BYTES] for at in range(0, len(text), BLOCK_BYTES)]
        bad, good = (sum(len(c.compress(block)) for block in blocks) for c in self._compressors)
        return bad, good

    def evidence(self, text: str | None) -> tuple[float, ...]:
        """Normalised difference of sizes, logarithms of shrinkage and length, and the difference weighed by length."""
        data = (text or "").encode("utf-8", "surrogatepass")
        bad, good = self.sizes(data)
        difference = (bad - good) / (bad + good) if bad + good else 0.0
        shrinkage = float(np.log((min(bad, good) + 4.0) / (len(data) + 4.0)))
        length = float(np.log(len(data) + 4.0))
        return difference, shrinkage, shrinkage**2, length, difference * length

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.share
        return float(_logistic(np.append(1.0, self.evidence(text)) @ self.weights))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def calibrate(evidence: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (intercept first) of a logistic regression with a ridge on the scaled evidence, by damped Newton steps."""
    middle, scale = evidence.mean(0), evidence.std(0) + 1e-9
    x = np.column_stack([np.ones(len(evidence)), (evidence - middle) / scale])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        margin = (2.0 * labels - 1.0) * (x @ w)
        return float((weight * np.logaddexp(0.0, -margin)).sum() + 0.5 * (ridge * w * w).sum())

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = _logistic(x @ w)
        gradient = x.T @ (weight * (p - labels)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1.0 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        size, before = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > before:
            size /= 2.0
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    slopes = w[1:] / scale
    return np.append(w[0] - slopes @ middle, slopes)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Model:
    """Learn from labelled documents that are not held out: label 1 is good, 0 bad, others and nulls are left out.

    A document that occurs several times counts once, with its least text; null
    texts count as empty. Without labels every score is 0.5; with one label
    only, or none left to calibrate with, the share of good ones.
    """
    spark = prepared(docs.sparkSession)
    marked = labels.select(quoted(doc_id).alias("doc_id"), quoted(quality).cast("int").alias("quality"))
    marked = marked.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct()
    counts = {row["quality"]: row["count"] for row in marked.groupBy("quality").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Model((b"", b""), None, share)
    quota = F.when(F.col("quality") == 1, min(1.0, SAMPLE / counts[1])).otherwise(min(1.0, SAMPLE / counts[0]))
    scale = 1 << 30
    chosen = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) / float(scale) < quota)
    # at most about twice SAMPLE rows of two numbers
    texts = docs.select(quoted(doc_id).alias("doc_id"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    builds = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(10)) < BUILD_TENTHS
    per_text = [-(-10 * PIECES // (BUILD_TENTHS * min(SAMPLE, counts[q]))) for q in (0, 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["quality"], r["doc_id"], at, x) for r in batch.to_pylist() for at, x in enumerate(pieces(r["text"].encode("utf-8", "surrogatepass"), per_text[r["quality"]]))]
            columns = zip(*rows) if rows else [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), batch.schema.field("doc_id").type, pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["quality", "doc_id", "at", "piece"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    cuts = sample.filter(builds).select("doc_id", "quality", "text").mapInArrow(cut, f"quality int, doc_id {kind}, at int, piece binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[bytes]] = [[], []]
        for batch in batches:
            for label, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                found[label].append(piece)
        yield pa.RecordBatch.from_arrays([pa.array([dictionary(x)], pa.binary()) for x in found], names=["bad", "good"])

    # one task for at most about 2 * PIECES pieces; their order decides what the dictionaries hold
    mixed = cuts.withColumn("mark", F.xxhash64("doc_id", "at")).repartition(1).sortWithinPartitions("mark", "doc_id", "at")
    built = mixed.mapInArrow(build, "bad binary, good binary").first()
    model = Model((bytes(built["bad"]), bytes(built["good"])) if built else (b"", b""))
    held = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.evidence(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["quality", "evidence"])

    rest = sample.filter(~builds).select("quality", "text").mapInArrow(weigh, "quality int, evidence array<double>")
    table = rest.orderBy("quality", "evidence").toArrow()
    known = np.array(table["quality"].to_pylist(), float)
    if not 0 < known.sum() < len(known):
        return Model(model.dictionaries, None, share)
    # each class weighs as much as it does among all labels
    weight = np.where(known == 1, share / known.mean(), (1.0 - share) / (1.0 - known.mean()))
    return Model(model.dictionaries, calibrate(np.array(table["evidence"].to_pylist()), known, weight), share)


def classify(docs: DataFrame, model: Model, text: str = "text", result: str = "score") -> DataFrame:
    """Every row with the probability that it is good; the text alone decides.

    A null text counts as empty and gets the score of a text without evidence;
    long texts are read whole; an empty table stays empty. A column named like
    the result is replaced.
    """
    held = prepared(docs.sparkSession).sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != result.lower()]
    schema = docs.select(*[quoted(c) for c in kept]).schema.add(result, "double")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([held.value.score(x.as_py()) for x in batch.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=schema.names)

    return docs.select(quoted(text).alias("_text"), *[quoted(c) for c in kept]).mapInArrow(work, schema)
