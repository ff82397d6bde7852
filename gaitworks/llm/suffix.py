"""Suffix-array dedup on bytes.

Repeated stretches of ``window`` bytes are found with suffix arrays, built by
induced sorting (see ``induced``): suffixes are classified, leftmost-smaller
substrings sorted recursively, the shard's array induced in two linear scans,
and permuted common prefixes tell for each byte how far it repeats.

No array is built over all texts. Runs of windows with one anchor (see
``runs``) are dealt to shards by anchor: equal windows have equal anchors, so
whatever repeats meets in one shard. Runs that occur more than once as a whole
need no array, and of the others one representative per distinct run goes into
its shard, cut to the part that can repeat at all. An anchor with very many
distinct runs is dealt to pairs of parts, so that every two runs still meet and
no shard outgrows its bound.

Texts are UTF-8 bytes; null is empty; matches never cross texts. Equal rows are
occurrences of their own. Columns of the input that have the name of a result
column are replaced; all others come through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm import runs as R
from gaitworks.llm.common import BYTE_VALUES, mix, prefix_sums, prepared, quoted, span_hashes, stored, string_bytes
from gaitworks.llm.groups import by_group
from gaitworks.llm.induced import common_prefixes, suffix_array

RESULTS = ("kept", "n_bytes", "n_removed", "n_spans")
#: Runs in a shard, on average; an anchor with more distinct runs is dealt to pairs of parts.
SHARD_RUNS = 2048
FRAGMENT_SCHEMA = (
    "anchor long, digest long, n long, m long, k1 long, k2 long, start long, windows long, place long, fragment binary"
)


def _cut_fragments(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts, k1s, k2s, items = (batch.column(i) for i in range(4))
            for row in range(batch.num_rows):
                key = (k1s[row].as_py(), k2s[row].as_py())
                if key in seen:
                    continue
                seen.add(key)
                data = texts[row].as_py().encode()
                out = items[row].as_py()
                for item in out:
                    item["k1"], item["k2"] = key
                    item["fragment"] = data[item["start"] : item["start"] + item["windows"] - 1 + window]
                names = [field.split()[0] for field in FRAGMENT_SCHEMA.split(", ")]
                columns = [pa.array([item[name] for item in out], pa.binary() if name == "fragment" else pa.int64()) for name in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def possible(group: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """By fragment, the first and last of its windows that can occur in another fragment (last below first: none).

    Windows are taken in steps by their distance to the anchor. All windows of a
    step share a long piece at a fixed distance; if no other fragment of the
    anchor has this piece there, none of them can repeat.
    """
    step = max(window // 9, 1)
    sums = prefix_sums(BYTE_VALUES[data])
    place, windows = group["place"], group["windows"]
    low, high = place - windows + 1, place
    first, last = np.full(len(place), 1 << 62), np.full(len(place), -1)
    for a in range(0, int(high.max()) + 1, step):
        rows = np.flatnonzero((high >= a) & (low < a + step))
        if len(rows) < 2:
            continue
        begin = offsets[rows] + place[rows] - a
        hashes = mix(span_hashes(sums, begin, begin + window - step + 1) ^ mix(group["anchor"][rows].view(np.uint64)))
        _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = rows[counts[inverse] > 1]
        # in terms of window numbers within the fragment
        first[hit] = np.minimum(first[hit], np.maximum(place[hit] - (a + step - 1), 0))
        last[hit] = np.maximum(last[hit], np.minimum(place[hit] - a, windows[hit] - 1))
    return first, last


def _repeats(window: int):
    def find(table: pa.Table) -> pa.Table | None:
        table = table.combine_chunks()
        group = {name: table[name].to_numpy() for name in table.column_names if name != "fragment"}
        # rows of equal text may each have sent the same fragment
        order = np.lexsort((group["digest"], group["anchor"]))
        same = (np.diff(group["anchor"][order]) == 0) & (np.diff(group["digest"][order]) == 0)
        rows = np.sort(order[np.concatenate(([True], ~same))])
        data, offsets = string_bytes(table["fragment"].combine_chunks().take(pa.array(rows)))
        group = {name: values[rows] for name, values in group.items()}
        first, last = possible(group, data, offsets, window)
        chosen = np.flatnonzero(last >= first)
        if not len(chosen):
            return None
        begin, end = offsets[chosen] + first[chosen], offsets[chosen] + last[chosen] + window
        # symbols: 0 ends the shard, 1 ends a fragment, bytes from 2
        lengths = end - begin + 1
        starts = np.cumsum(lengths) - lengths
        symbols = np.ones(int(lengths.sum()) + 1, np.int64)
        inner = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
        inside = np.flatnonzero(inner < np.repeat(lengths - 1, lengths))
        symbols[inside] = data[(np.repeat(begin, lengths) + inner)[inside]].astype(np.int64) + 2
        symbols[-1] = 0
        before, after = common_prefixes(symbols, suffix_array(symbols))
        left = np.append(np.repeat(lengths - 1, lengths) - inner, 0)
        repeated = (np.minimum(np.maximum(before, after), left) >= window)[:-1]
        owner = np.repeat(np.arange(len(chosen)), lengths)
        repeated &= (group["n"][chosen] == 1)[owner]
        at = np.flatnonzero(repeated)
        if not len(at):
            return None
        cut = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
        head, count = at[cut], np.diff(np.append(cut, len(at)))
        row = chosen[owner[head]]
        place = group["start"][row] + first[row] + inner[head]
        return pa.table({"k1": group["k1"][row], "k2": group["k2"][row], "start": place, "windows": count})

    return find


def repeated_spans(docs: DataFrame, text: str = "text", window: int = 400, gram: int = 32) -> DataFrame:
    """Stretches of repeated windows: ``k1, k2`` (the text), ``start`` (a byte) and ``windows`` (how many start there)."""
    label = "suffix"
    found = stored(R.scan_runs(docs, text, window, gram, "bytes"), f"{label}-runs")
    shared, classes = R.shared_runs(found, label)
    branching = stored(R.open_classes(classes, label), f"{label}-open")
    texts = R.with_text(docs, text, branching, label)
    fragments = texts.mapInArrow(_cut_fragments(window), FRAGMENT_SCHEMA)
    shards = max(1, -(-branching.count() // SHARD_RUNS))
    parts = F.ceil(F.col("m") * 2 / SHARD_RUNS)
    part = F.pmod(F.xxhash64("digest"), parts)
    every = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda x: F.xxhash64("anchor", F.least(x, part), F.greatest(x, part)))
    shard = F.when(F.col("m") <= SHARD_RUNS, F.array(F.pmod(F.xxhash64("anchor"), F.lit(shards).cast("long")))).otherwise(every)
    dealt = fragments.select(F.explode(shard).alias("shard"), "*").drop("m")
    single = by_group(dealt, ["shard"], _repeats(window), "k1 long, k2 long, start long, windows long")
    return R.whole_spans(shared, classes).unionByName(single)


def remove_repeated(docs: DataFrame, text: str = "text", window: int = 400, gram: int = 32) -> DataFrame:
    """Every row, with ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans`` (removed stretches).

    A byte goes if a string of ``window`` bytes that covers it also starts
    anywhere else, in the same text or another one; strings are judged on the
    input. ``kept`` is binary: a cut may fall inside a character. Null texts count
    as empty, very long ones are searched whole, equal rows are each other's
    repeats, and an empty table gives no rows.
    """
    prepared(docs.sparkSession)
    spans = repeated_spans(docs, text, window, gram)
    joined, name = R.with_spans(docs, text, spans, "suffix")
    others = [c for c in docs.columns if c.lower() not in RESULTS]
    source = joined.select(quoted(text), quoted(name), *[quoted(c) for c in others])
    schema = joined.select(*[quoted(c) for c in others]).schema
    schema = schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, totals, removed, counts = [], [], [], []
            for value, listed in zip(batch.column(0), batch.column(1)):
                data = (value.as_py() or "").encode()
                gaps = R.covered(listed.as_py(), window)
                stay, at = [], 0
                for start, end in gaps:
                    stay.append(data[at:start])
                    at = end
                stay.append(data[at:])
                kept.append(b"".join(stay))
                totals.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                counts.append(len(gaps))
            results = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (totals, removed, counts))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *results], names=schema.names)

    return source.mapInArrow(cut, schema)
