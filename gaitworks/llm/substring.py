"""Substring dedup on words, by runs of windows and their hashes.

The windows of ``window`` words are the edges of a De Bruijn graph, but the
graph is not compacted by joins: a run of windows with one anchor (see
``runs``) stands in for a path, and texts may part within it. Equal runs
collapse to one row in a Spark aggregate on 128 bits of hash; those that occur
more than once as a whole are repeated window by window. Only where an anchor
has several different runs, single windows are opened, one representative per
run, and found again by their hashes. The words themselves are not compared.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D. Null text is
empty. Equal rows are occurrences of their own. Columns of the input that have
the name of a result column are replaced; all others come through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm import runs as R
from gaitworks.llm.common import SPACE, long_array, mix, powers, prefix_sums, prepared, quoted, stored, string_bytes

RESULTS = ("kept", "n_words", "n_removed", "n_spans")
EDGE_SCHEMA = "anchor long, edge long, path long, place long, many boolean, k1 long, k2 long, start long"


def _edges(window: int):
    def open_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in EDGE_SCHEMA.split(", ")]
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts, k1s, k2s, items = (batch.column(i) for i in range(4))
            for row in range(batch.num_rows):
                key = (k1s[row].as_py(), k2s[row].as_py())
                if key in seen:
                    continue
                seen.add(key)
                hashes, _ = R.symbols(*string_bytes(texts.slice(row, 1)), "words")
                sums, back = prefix_sums(hashes), powers(len(hashes) + 1)[1]
                edges = mix((sums[window:] - sums[:-window]) * back[: len(sums) - window])
                found = pa.Table.from_pylist(items[row].as_py())
                first = found["start"].to_numpy()
                count = found["windows"].to_numpy()
                path = np.repeat(np.arange(len(first)), count)
                place = np.arange(len(path)) - np.repeat(np.cumsum(count) - count, count)
                at = first[path] + place
                yield pa.RecordBatch.from_arrays(
                    [
                        long_array(found["anchor"].to_numpy()[path]),
                        long_array(edges[at]),
                        long_array(found["digest"].to_numpy()[path]),
                        long_array(place),
                        pa.array(found["n"].to_numpy()[path] > 1),
                        long_array(np.full(len(path), key[0])),
                        long_array(np.full(len(path), key[1])),
                        long_array(at),
                    ],
                    names=names,
                )

    return open_paths


def repeated_spans(docs: DataFrame, text: str = "text", window: int = 35, gram: int = 8) -> DataFrame:
    """Stretches of repeated windows: ``k1, k2`` (the text), ``start`` (a word) and ``windows`` (how many start there)."""
    label = "substring"
    found = stored(R.scan_runs(docs, text, window, gram, "words"), f"{label}-runs")
    shared, classes = R.shared_runs(found, label)
    texts = R.with_text(docs, text, R.open_classes(classes, label).drop("m", "place"), label)
    edges = stored(texts.mapInArrow(_edges(window), EDGE_SCHEMA), f"{label}-edges")
    # a path's edge may come more than once, from rows of equal text: least and greatest place tell that apart
    code = F.xxhash64("path", "place")
    sums = edges.groupBy("anchor", "edge").agg(F.max("many").alias("many"), F.min(code).alias("a"), F.max(code).alias("b"))
    repeated = stored(sums.filter("many or a <> b").select("anchor", "edge"), f"{label}-repeated")
    single = edges.filter("not many").join(repeated, ["anchor", "edge"], "left_semi")
    return R.whole_spans(shared, classes).unionByName(single.select("k1", "k2", "start", F.lit(1).cast("long").alias("windows")))


def without_words(data: bytes, gaps: list[tuple[int, int]]) -> bytes:
    """The text without the words of each gap and what is between them; all other white space stays as it is."""
    inside = np.concatenate([[False], ~SPACE[np.frombuffer(data, np.uint8)], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    stay, at = [], 0
    for start, end in gaps:
        stay.append(data[at : starts[start]])
        at = ends[end - 1]
    return b"".join([*stay, data[at:]])


def remove_repeated(docs: DataFrame, text: str = "text", window: int = 35, gram: int = 8, joined_words: bool = True) -> DataFrame:
    """Every row, with ``kept`` (the words that stay, joined by a space), ``n_words``, ``n_removed`` and ``n_spans``.

    A word goes if a window that covers it also starts anywhere else, in the
    same text or another one; windows are judged on the input. Without
    ``joined_words``, ``kept`` is the text itself, cut as ``without_words`` does.
    A null text has no words, very long ones are searched whole, equal rows are
    each other's repeats, and an empty table gives no rows.
    """
    prepared(docs.sparkSession)
    spans = repeated_spans(docs, text, window, gram)
    joined, name = R.with_spans(docs, text, spans, "substring")
    others = [c for c in docs.columns if c.lower() not in RESULTS]
    source = joined.select(quoted(text), quoted(name), *[quoted(c) for c in others])
    schema = joined.select(*[quoted(c) for c in others]).schema
    schema = schema.add("kept", "string").add("n_words", "long").add("n_removed", "long").add("n_spans", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, totals, removed, counts = [], [], [], []
            for value, listed in zip(batch.column(0), batch.column(1)):
                words = (value.as_py() or "").encode().split()
                gaps = R.covered(listed.as_py(), window)
                stay, at = [], 0
                for start, end in gaps:
                    stay += words[at:start]
                    at = end
                stay += words[at:]
                if joined_words:
                    kept.append(b" ".join(stay).decode())
                else:
                    kept.append(without_words(value.as_py().encode(), gaps).decode() if gaps else value.as_py())
                totals.append(len(words))
                removed.append(len(words) - len(stay))
                counts.append(len(gaps))
            results = [pa.array(kept, pa.string()), *(pa.array(x, pa.int64()) for x in (totals, removed, counts))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *results], names=schema.names)

    return source.mapInArrow(cut, schema)
