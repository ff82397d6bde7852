"""Repeated windows of symbols, found through runs of windows that share an anchor.

A window is ``window`` consecutive symbols (words or bytes) of one text. Its
anchor is the leftmost of its ``gram``-symbol pieces with the least hash, so
equal windows have equal anchors at equal places. Consecutive windows with one
and the same anchor form a run: a path along which no other text can join or
leave without changing a window. The runs are about two thirds of a window
long, so there are far fewer of them than windows.

Texts are known by 128 bits of their content. Rows of equal text have equal
runs and, in the end, equal spans; they count as separate occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import (
    BYTE_VALUES,
    free_name,
    long_array,
    mix,
    powers,
    prefix_sums,
    quoted,
    slices,
    span_hashes,
    stored,
    string_bytes,
    text_keys,
    word_hashes,
)

RUN_SCHEMA = "k1 long, k2 long, anchor long, digest long, start long, windows long, place long"
#: The sliding minimum keeps a place in the low bits of a hash, so a pass has at most so many symbols.
_PLACE_BITS = 24
_PASS = 1 << 22
#: A span is one integer: the start, and in the low bits the number of windows (at most one anchor's, or a shard's fragment).
_SPAN_BITS = 20


def symbols(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each symbol, and the symbols before each text."""
    if kind == "words":
        return word_hashes(data, offsets)
    return BYTE_VALUES[data], offsets


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def window_runs(hashes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all texts in a slice, for each run: text, start in it, number of windows, the anchor's place, anchor and digest."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(offsets) == 2 and len(hashes) > _PASS + window:
        found = []
        for at in range(0, len(hashes) - window + 1, _PASS):
            part = hashes[at : at + _PASS + window - 1]
            text, start, *others = window_runs(part, np.array([0, len(part)]), window, gram)
            found.append((text, start + at, *others))
        return tuple(np.concatenate(x) for x in zip(*found))
    if len(hashes) < window:
        return none
    sums, back = prefix_sums(hashes), powers(len(hashes) + 1)[1]
    grams = mix((sums[gram:] - sums[:-gram]) * back[: len(sums) - gram])
    place = np.uint64((1 << _PLACE_BITS) - 1)
    low = _sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & place
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(owner[: len(low)] == owner[window - 1 :])
    if not len(starts):
        return none
    anchors = low[starts].astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    first, at = starts[cut], anchors[cut]
    count = np.diff(np.append(cut, len(starts)))
    extra = (at - first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + count.astype(np.uint64)
    digest = mix(span_hashes(sums, first, first + count - 1 + window) + mix(extra))
    return owner[first], first - offsets[:-1][owner[first]], count, at - first, grams[at], digest


def scan_runs(docs: DataFrame, text: str, window: int, gram: int, kind: str) -> DataFrame:
    """All runs of all rows. Null and empty texts, and those shorter than a window, have none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in RUN_SCHEMA.split(", ")]
        for batch in batches:
            for part in slices(batch, 0):
                data, offsets = string_bytes(part.column(0))
                owner, start, count, place, anchor, digest = window_runs(*symbols(data, offsets, kind), window, gram)
                keys = [part.column(i).to_numpy()[owner] for i in (1, 2)]
                columns = [*keys, anchor, digest, start, count, place]
                yield pa.RecordBatch.from_arrays([long_array(x) for x in columns], names=names)

    k1, k2 = text_keys(quoted(text))
    return docs.select(F.coalesce(quoted(text), F.lit("")), k1.alias("k1"), k2.alias("k2")).mapInArrow(find, RUN_SCHEMA)


def shared_runs(runs: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Runs whose anchor occurs more than once, and their classes: equal runs collapsed to one, with their number.

    The count of anchors is summed before it travels, and a frequent anchor's
    runs are rows of a semi join, which adaptive execution splits: it can do so
    only where both sides come straight from a shuffle, so the anchors are stored.
    """
    anchors = stored(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), f"{label}-anchors")
    shared = stored(runs.join(anchors, "anchor", "left_semi"), f"{label}-shared")
    one = F.min(F.struct("k1", "k2", "start", "windows", "place"))
    classes = shared.groupBy("anchor", "digest").agg(F.count("*").alias("n"), one.alias("one"))
    return shared, stored(classes.select("anchor", "digest", "n", "one.*"), f"{label}-classes")


def whole_spans(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Runs that occur more than once as they are."""
    many = classes.filter("n > 1").select("anchor", "digest")
    return shared.join(many, ["anchor", "digest"], "left_semi").select("k1", "k2", "start", "windows")


def open_classes(classes: DataFrame, label: str) -> DataFrame:
    """Classes of anchors that have several (``m``): where texts branch, so that single windows must be compared."""
    several = stored(classes.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), f"{label}-branching")
    return classes.join(several, "anchor")


def with_text(docs: DataFrame, text: str, classes: DataFrame, label: str) -> DataFrame:
    """The texts that hold the representatives of classes, with a list of them: ``text, k1, k2, items``.

    Rows of equal text all come; whoever reads this must not count them twice.
    """
    columns = [name for name in classes.columns if name not in ("k1", "k2")]
    items = classes.groupBy("k1", "k2").agg(F.collect_list(F.struct(*columns)).alias("items"))
    k1, k2 = text_keys(quoted(text))
    texts = docs.select(F.coalesce(quoted(text), F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))
    return texts.join(stored(items, f"{label}-items"), ["k1", "k2"]).select("text", "k1", "k2", "items")


def with_spans(docs: DataFrame, text: str, spans: DataFrame, label: str) -> tuple[DataFrame, str]:
    """All rows, with the spans of their text in a new last column (null if none) whose name is returned."""
    span = F.shiftleft("start", _SPAN_BITS).bitwiseOR(F.col("windows"))
    listed = spans.select("k1", "k2", span.alias("span")).distinct().groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))
    names = [free_name(docs.columns, name) for name in ("k1", "k2", "spans")]
    side = stored(listed.toDF(*names), f"{label}-spans")
    k1, k2 = text_keys(quoted(text))
    keyed = docs.select("*", k1.alias(names[0]), k2.alias(names[1]))
    joined = keyed.join(side, names[:2], "left")
    return joined.select(*[quoted(c) for c in docs.columns], names[2]), names[2]


def covered(spans: list[int] | None, window: int) -> list[tuple[int, int]]:
    """The maximal covered stretches, in order, from starts of windows and their numbers in one integer."""
    merged: list[tuple[int, int]] = []
    for span in sorted(spans or ()):
        start = span >> _SPAN_BITS
        end = start + (span & ((1 << _SPAN_BITS) - 1)) - 1 + window
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged
