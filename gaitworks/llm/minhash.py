"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct shingles of five words (A to Z lower-cased;
with fewer words the whole sequence is one shingle). Two documents are linked
if the Jaccard similarity of their sets is ``percent`` per cent or more.

1. Each row's set gives its size, a 128-bit fingerprint and a sketch of
   ``bands * rows`` registers. A register is an exponentially spaced level of
   the least of exponentially distributed values, cut to 16 bits; the register
   of a union is the greater one, and registers of similar sets tend to agree.
2. Rows of equal sets collapse to one class in an aggregate.
3. Classes that agree in all registers of a band share a bucket. Buckets are
   compared in blocks of bounded size, so a bucket may be of any size. A pair
   is a candidate unless the joint likelihood of its registers and set sizes
   speaks against the wanted similarity by five standard deviations. Only a
   spanning forest of the candidates leaves a block.
4. Components of the candidates are clusters. In each, again in blocks, the
   candidates are confirmed on their full sets. Pairs that confirmed links have
   joined already in the block need no look.
5. Components of the confirmed links are the groups.

A link at the threshold itself shares no bucket with a chance of 7 in a
million, and far less above it. Null texts and those without words have empty
sets and are linked with nothing. Equal rows are linked with each other. Null
doc_ids count as greater than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.llm.common import (
    checked,
    free_name,
    long_array,
    mix,
    powers,
    prefix_sums,
    prepared,
    quoted,
    slices,
    span_hashes,
    stored,
    string_bytes,
    text_keys,
    word_hashes,
)
from gaitworks.llm.components import components
from gaitworks.llm.groups import by_group

SHINGLE = 5
BANDS, ROWS = 25, 6
BASE, RATE, LEVELS = 1.001, 20.0, (1 << 16) - 1
#: Members of a block, and bytes of sets in it on average.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Twice the fall of the log likelihood at which a pair is ruled out: five standard deviations.
RULED_OUT = 25.0

_random = np.random.default_rng(5077)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, places = word_hashes(data, offsets, fold=True)
    sums, back = prefix_sums(words), powers(len(words) + 1)[1]
    last = max(len(words) - SHINGLE + 1, 0)
    full = mix((sums[SHINGLE:] - sums[:last]) * back[:last]) if last else np.zeros(0, np.uint64)
    found = []
    for start, end in zip(places[:-1], places[1:]):
        count = end - start
        if count >= SHINGLE:
            found.append(np.unique(full[start : end - SHINGLE + 1]))
        elif count:
            whole = span_hashes(sums, np.array([start]), np.array([end]))
            found.append(mix(whole + np.array([count], np.uint64) * np.uint64(0xA24BAED4963EE407)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The registers of non-empty sets laid end to end, as rows of 16-bit levels."""
    out = np.empty((len(starts), len(_FACTORS)), np.uint16)
    for i, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS)):
        least = np.minimum.reduceat(values * factor + shift, starts)
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, i] = np.clip(np.floor(1.0 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, LEVELS)
    return out


SCAN_SCHEMA = "n long, f1 long, f2 long, sketch binary"


def _scan(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 0):
            sets = shingle_sets(*string_bytes(part.column(0)))
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            first, second = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            sketches: list[bytes | None] = [None] * len(sets)
            if len(some):
                values = np.concatenate(sets)
                starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                first[some] = np.add.reduceat(mix(values ^ np.uint64(0x1234567)), starts)
                second[some] = np.add.reduceat(mix(values ^ np.uint64(0x89ABCDEF01)), starts)
                for row, levels in zip(some, registers(values, starts)):
                    sketches[row] = levels.tobytes()
            columns = [long_array(sizes), long_array(first), long_array(second), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=names)


def _levels(column: pa.Array) -> np.ndarray:
    return np.frombuffer(string_bytes(column)[0], np.uint16).reshape(len(column), BANDS * ROWS)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels = _levels(batch.column(1)).astype(np.uint64).reshape(batch.num_rows, BANDS, ROWS)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((batch.num_rows, 1), np.uint64)
        for i in range(ROWS):
            keys = mix(keys ^ (levels[:, :, i] + np.uint64(i << 32)))
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([long_array(keys.ravel()), pa.array(ids)], names=["bucket", "id"])


def likely(agree: np.ndarray, above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray, wanted: float) -> np.ndarray:
    """The most likely similarity of pairs, or -1 where the registers rule out ``wanted``.

    ``agree``, ``above`` and ``below`` count registers in which the first set's
    level is equal, greater and less; ``n`` and ``m`` are the sizes of the sets.
    """
    u = n / (n + m)
    v = 1.0 - u
    limit = np.minimum(u / v, v / u)
    scale = (BASE - 1.0) / BASE

    def score(similarity: np.ndarray) -> np.ndarray:
        more = -np.log1p(-np.maximum(u - v * similarity, 0) * scale) / np.log(BASE)
        less = -np.log1p(-np.maximum(v - u * similarity, 0) * scale) / np.log(BASE)
        same = np.maximum(1.0 - more - less, 1e-9)
        return above * np.log(np.maximum(more, 1e-9)) + below * np.log(np.maximum(less, 1e-9)) + agree * np.log(same)

    # for a base close to 1 the peak of the likelihood is the lesser root of a quadratic equation
    square = u * v * (agree + above + below)
    linear = agree * (u**2 + v**2) + above * v**2 + below * u**2
    under = np.maximum(linear**2 - 4.0 * square * agree * u * v, 0.0)
    best = np.clip((linear - np.sqrt(under)) / (2.0 * square), 0.0, limit)
    at = np.minimum(wanted, limit)
    out = (best < wanted) & (2.0 * (score(best) - score(at)) > RULED_OUT)
    return np.where(out | (limit < wanted - 1e-12), -1.0, best)


def candidates(levels: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray, wanted: float):
    """Pairs of a row of ``first`` and one of ``second`` that may be similar enough: rows, rows and estimate, best first."""
    left, right, agree, above = [], [], [], []
    for row in first:
        others = second[second > row] if first is second else second
        near = others[np.minimum(sizes[others], sizes[row]) >= wanted * np.maximum(sizes[others], sizes[row]) - 1e-9]
        equal = (levels[near] == levels[row]).sum(1)
        some = equal * 2 >= levels.shape[1]
        near = near[some]
        left.append(np.full(len(near), row))
        right.append(near)
        agree.append(equal[some])
        above.append((levels[near] < levels[row]).sum(1))
    rows, others, equal, more = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, agree, above))
    if not len(rows):
        return rows, others
    estimate = likely(equal, more, levels.shape[1] - equal - more, sizes[rows].astype(float), sizes[others].astype(float), wanted)
    keep = np.flatnonzero(estimate >= 0)
    order = keep[np.argsort(-estimate[keep], kind="stable")]
    return rows[order], others[order]


class Forest:
    """Which rows of a block are joined already."""

    def __init__(self, count: int):
        self.up = list(range(count))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[x] = y
        return x != y


def _block_rows(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the first and of the second block; the same array if it is one block."""
    part, i, j = (group[name].to_numpy() for name in ("part", "i", "j"))
    if i[0] == j[0]:
        rows = np.arange(len(part))
        return rows, rows
    return np.flatnonzero(part == i[0]), np.flatnonzero(part == j[0])


def _candidate_links(wanted: float):
    def links(group: pa.Table) -> pa.Table | None:
        if group.num_rows < 2:
            return None
        ids, sizes = group["id"].to_numpy(), group["n"].to_numpy()
        levels = _levels(group["sketch"].combine_chunks())
        forest, found = Forest(len(ids)), []
        for x, y in zip(*candidates(levels, sizes, *_block_rows(group), wanted)):
            if forest.join(x, y):
                found.append((ids[x], ids[y]))
        return pa.table({"a": [int(a) for a, _ in found], "b": [int(b) for _, b in found]}) if found else None

    return links


def _true_links(percent: int):
    def links(group: pa.Table) -> pa.Table | None:
        if group.num_rows < 2:
            return None
        ids, sizes = group["id"].to_numpy(), group["n"].to_numpy()
        levels = _levels(group["sketch"].combine_chunks())
        data, offsets = string_bytes(group["members"].combine_chunks())
        sets = np.frombuffer(data.tobytes(), np.uint64)
        bounds = offsets // 8

        def common_to(x: int, y: int) -> int:
            """How many values two sorted sets share; the smaller one is looked up in the larger."""
            small, large = sorted((sets[bounds[i] : bounds[i + 1]] for i in (x, y)), key=len)
            return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())

        forest, found = Forest(len(ids)), []
        for x, y in zip(*candidates(levels, sizes, *_block_rows(group), percent / 100.0)):
            if forest.top(x) == forest.top(y):
                continue
            common = common_to(x, y)
            if 100 * common >= percent * (int(sizes[x]) + int(sizes[y]) - common):
                forest.join(x, y)
                found.append((ids[x], ids[y]))
        return pa.table({"a": [int(a) for a, _ in found], "b": [int(b) for _, b in found]}) if found else None

    return links


def _blocks(rows: DataFrame, group: str, count: F.Column) -> DataFrame:
    """Deal the rows of a group into ``count`` parts, and each part to its pairs with all parts: ``part, i, j``."""
    dealt = rows.withColumn("parts", count).withColumn("part", F.pmod(F.xxhash64("id", group), F.col("parts")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return other.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, 0):
            ids = part.column(1).to_numpy()
            fresh = [i for i, x in enumerate(ids) if x not in seen and not seen.add(int(x))]
            if not fresh:
                continue
            chosen = part.take(pa.array(fresh))
            sets = shingle_sets(*string_bytes(chosen.column(0)))
            yield pa.RecordBatch.from_arrays(
                [chosen.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"]
            )


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row of each group, with the columns of the input: the one with the least doc_id.

    Rows without words are groups of their own. Of several rows with the least
    doc_id, or of a group without any, the one with the least hash stays.
    """
    group = free_name([*docs.columns, "n_shingles", "component_id", "kept"], "group")
    found = near_duplicates(docs, doc_id, text, percent, group).filter("kept")
    rows = found.select(*[quoted(c) for c in docs.columns if c.lower() not in ("n_shingles", "component_id", "kept")], group, "n_shingles")
    narrow = rows.filter("n_shingles > 0").groupBy(group).count().filter("count > 1")
    chosen = rows
    if not narrow.isEmpty():
        order = Window.partitionBy(group).orderBy(*text_keys(quoted(text)), F.xxhash64(quoted(doc_id)))
        place = free_name(rows.columns, "place")
        one = rows.filter("n_shingles > 0").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
        chosen = one.unionByName(rows.filter("n_shingles = 0"))
    return chosen.select(*[quoted(c) for c in rows.columns if c not in (group, "n_shingles")])


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, group: str | None = None
) -> DataFrame:
    """Every row with ``n_shingles``, ``component_id`` (the least doc_id of its group) and ``kept``.

    ``kept`` tells the rows whose doc_id is their group's, and all rows of
    groups without any doc_id. Very long texts are read whole; an empty table
    gives no rows. Columns of these names in the input are replaced.
    ``group`` names one more column, if wanted: a number for each group, null
    for rows without words.
    """
    prepared(docs.sparkSession)
    label, wanted = "minhash", percent / 100.0
    k1, k2 = text_keys(quoted(text))
    # what the sets say, row by row; rows of equal text share it, so the text's key leads back
    names = ["doc", "k1", "k2", "n", "f1", "f2", "sketch"]
    scanned = docs.select(
        F.coalesce(quoted(text), F.lit("")), quoted(doc_id).cast("long").alias("doc"), k1.alias("k1"), k2.alias("k2")
    ).mapInArrow(lambda batches: _scan(batches, names), "doc long, k1 long, k2 long, " + SCAN_SCHEMA)
    rows = stored(scanned, f"{label}-rows")
    classes = (
        rows.filter("n > 0")
        .groupBy("n", "f1", "f2")
        .agg(F.min("doc").alias("doc"), F.min(F.struct("k1", "k2", F.col("doc").alias("row"))).alias("k"), F.first("sketch").alias("sketch"))
        .select("n", "f1", "f2", "doc", "k.*", "sketch", F.monotonically_increasing_id().alias("id"))
    )
    classes = stored(classes, f"{label}-classes")

    buckets = classes.select("id", "sketch").mapInArrow(_buckets, "bucket long, id long")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1")
    shared = stored(shared, f"{label}-buckets")
    members = buckets.join(shared, "bucket").join(classes.select("id", "n", "sketch"), "id")
    dealt = _blocks(members, "bucket", F.ceil(F.col("many") / BLOCK)).drop("many")
    found = by_group(dealt, ["bucket", "i", "j"], _candidate_links(wanted), "a long, b long")
    clusters = stored(components(found), f"{label}-clusters")

    sizes = clusters.join(classes.select(F.col("id").alias("node"), "n"), "node")
    parts = sizes.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("count"))
    # one row of a class gives its set, however many copies there are; only rows that repeat its doc_id, too, are dropped behind
    wanted_rows = classes.join(clusters, classes["id"] == clusters["node"])
    wanted_rows = checked(stored(wanted_rows.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "row", "id"), f"{label}-wanted"))
    t1, t2 = text_keys(quoted(text))
    texts = docs.select(F.coalesce(quoted(text), F.lit("")).alias("text"), t1.alias("k1"), t2.alias("k2"), quoted(doc_id).cast("long").alias("doc"))
    same_row = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & F.col("doc").eqNullSafe(F.col("row"))
    texts = texts.join(wanted_rows, same_row).select("text", "id")
    sets = stored(texts.mapInArrow(_set_rows, "id long, members binary").dropDuplicates(["id"]), f"{label}-sets")
    named = clusters.join(parts, "component").select(F.col("node").alias("id"), "component", "count")
    full = sets.join(named, "id").join(classes.select("id", "n", "sketch"), "id")
    blocks = _blocks(full, "component", F.col("count")).drop("count")
    links = by_group(blocks, ["component", "i", "j"], _true_links(percent), "a long, b long")
    groups = stored(components(links), f"{label}-groups")

    named_groups = classes.join(groups, classes["id"] == groups["node"], "left").withColumn("g", F.coalesce("component", "id"))
    least = stored(named_groups.groupBy("g").agg(F.min("doc").alias("least")), f"{label}-least")
    answer = named_groups.join(least, "g").select("n", "f1", "f2", "least", "g")
    per_row = rows.select("doc", "k1", "k2", "n", "f1", "f2").join(answer, ["n", "f1", "f2"], "left")
    per_text = stored(
        per_row.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("least").alias("least"), F.first("g").alias("g")),
        f"{label}-answer",
    )

    results = ("n_shingles", "component_id", "kept")
    inner = [free_name(docs.columns, name) for name in ("k1", "k2", "n", "least", "g")]
    d1, d2 = text_keys(quoted(text))
    joined = docs.select("*", d1.alias(inner[0]), d2.alias(inner[1])).join(checked(per_text.toDF(*inner)), inner[:2], "left")
    own, count = quoted(doc_id).cast("long"), F.col(inner[2])
    component = F.when(count > 0, F.col(inner[3])).otherwise(own)
    return joined.select(
        *[quoted(c) for c in docs.columns if c.lower() not in results],
        count.alias("n_shingles"),
        component.alias("component_id"),
        F.when(component.isNull(), F.lit(True)).otherwise(F.coalesce(own == component, F.lit(False))).alias("kept"),
        *([F.col(inner[4]).alias(group)] if group else []),
    )
