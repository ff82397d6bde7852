"""Exact top-k search by inner product, with multi-resolution segment statistics.

Components are scaled to integers, so scores are exact. A vector is cut into
segments, and each segment has a mean and a deviation. Means and deviations
bound an inner product from above, as they bound a distance from below. Bounds
of one, then four, then sixteen segments rule out candidates that cannot reach
a query's k-th best score so far; what survives is computed exactly.

Queries and candidates are dealt in blocks of bounded size; each pair of a
query block and a candidate shard is one group of rows, which gives k rows per
query at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.llm.common import prepared, quoted
from gaitworks.llm.groups import by_group

SCALE = 1024.0
LEVELS = (1, 4, 16)
QUERY_BLOCK, SHARD, STEP = 1024, 8192, 1024
#: Values in a block at most, for wide vectors.
BLOCK_VALUES = 1 << 22


def usable(values: Column) -> Column:
    """Neither null nor empty, and every component finite."""
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(values) > 0) & finite, F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Integer components as doubles if every inner product is then exact, else as Python integers."""
    whole = np.floor(vectors.astype(np.float64) * SCALE)
    if len(whole) and np.abs(whole).max() ** 2 * whole.shape[1] >= 2.0**53:
        return np.array([[int(x) for x in row] for row in whole], dtype=object)
    return whole


def features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Columns whose products with another vector's sum to an upper bound of the inner product."""
    parts = np.array_split(vectors.astype(np.float64), min(segments, vectors.shape[1]), axis=1)
    columns = []
    for part in parts:
        mean = part.mean(1)
        columns += [mean * np.sqrt(part.shape[1]), np.sqrt(((part - mean[:, None]) ** 2).sum(1))]
    return np.stack(columns, 1)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Row of the query, id and score of each query's best candidates in this shard, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    exact = vectors.dtype != object and queries.dtype != object
    least = np.full(len(queries), -np.inf)
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, vectors.dtype if exact else object))
    left = [features(queries, n) for n in LEVELS] if exact else []
    right = [features(vectors, n) for n in LEVELS] if exact else []
    for at in range(0, len(vectors), STEP):
        part = slice(at, at + STEP)
        if exact:
            # a rounding error of the bound must not rule out a candidate
            bound = left[0] @ right[0][part].T
            rows, columns = np.nonzero(bound * (1 + 1e-12 * np.sign(bound)) + 1e-3 >= least[:, None])
            for a, b in zip(left[1:], right[1:]):
                bounds = np.einsum("ij,ij->i", a[rows], b[part][columns])
                able = bounds * (1 + 1e-12 * np.sign(bounds)) + 1e-3 >= least[rows]
                rows, columns = rows[able], columns[able]
        else:
            rows, columns = (x.ravel() for x in np.indices((len(queries), len(vectors[part]))))
        other = query_ids[rows] != ids[part][columns]
        rows, columns = rows[other], columns[other] + at
        if exact:
            scores = np.einsum("ij,ij->i", queries[rows], vectors[columns])
        else:
            scores = np.array([int(queries[r] @ vectors[c]) for r, c in zip(rows, columns)], dtype=object)
        kept = tuple(np.concatenate(x) for x in zip(kept, (rows, columns, scores)))
        if exact:
            order = np.lexsort((kept[1], -kept[2], kept[0]))
        else:
            order = np.array(sorted(range(len(kept[0])), key=lambda i: (kept[0][i], -kept[2][i], kept[1][i])), np.int64)
        kept = tuple(x[order] for x in kept)
        first = np.searchsorted(kept[0], kept[0])
        place = np.arange(len(first)) - first
        kth = np.flatnonzero(place == k - 1)
        if exact:
            least[kept[0][kth]] = kept[2][kth]
        kept = tuple(x[place < k] for x in kept)
    return kept[0], ids[kept[1]], kept[2]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", values: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates with the highest inner product for every query.

    Queries are the rows for which ``is_query`` holds; candidates are all rows
    with another id. Null ids, and vectors that are null, empty or hold null or
    non-finite components, take no part; vectors of different widths do not
    meet. Rows that share an id are candidates each, and as queries they have
    one list. A score beyond 64 bits is shown as the nearest 64-bit integer.
    """
    prepared(vectors.sparkSession)
    rows = vectors.select(quoted(vec_id).cast("long").alias("id"), quoted(values).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q"), F.max(F.size("v")).alias("wide")).first()
    most = max(BLOCK_VALUES // (size["wide"] or 1), 64)
    blocks = max(1, -(-size["q"] // min(QUERY_BLOCK, most)))
    shards = max(1, -(-size["n"] // min(SHARD, most)))

    def dealt(count: int) -> Column:
        return F.pmod(F.xxhash64("id", "v"), F.lit(count).cast("long"))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    asked = rows.filter("q").select(dealt(blocks).alias("block"), every(shards).alias("shard"), "id", "v", F.lit(True).alias("q"))
    given = rows.select(every(blocks).alias("block"), dealt(shards).alias("shard"), "id", "v", F.lit(False).alias("q"))

    def search(group: pa.Table) -> pa.Table | None:
        ids, query = group["id"].to_numpy(), group["q"].to_numpy()
        lists = group["v"].combine_chunks()
        flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        widths = np.diff(bounds)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(widths[query]):
            mine, theirs = np.flatnonzero(query & (widths == width)), np.flatnonzero(~query & (widths == width))
            if len(theirs):
                matrix = scaled(flat[bounds[np.concatenate((mine, theirs))][:, None] + np.arange(width)])
                row, found, score = best(matrix[: len(mine)], ids[mine], matrix[len(mine) :], ids[theirs], k)
                out.append((ids[mine][row], found, score))
        if not out:
            return None
        asked, found, score = (np.concatenate([o[i] for o in out]) for i in range(3))
        top = (1 << 63) - 1
        whole = [min(max(int(s), -top - 1), top) for s in score]
        return pa.table({"query_id": asked, "vec_id": found, "score": pa.array(whole, pa.int64())})

    found = by_group(asked.unionByName(given), ["block", "shard"], search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
