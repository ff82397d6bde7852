"""Embedding near-dedup by an exact metric range join.

Angles between vectors obey the triangle inequality. A bounded sample of
vectors serves as pivots, and every vector belongs to the cell of its nearest
pivot. A cell also gets replicas of the vectors that may lie within reach of
one of its own: those whose angle to the pivot is no more than the cell's
radius and the reach together, and whose distance to the cell's border with
their own cell is within the reach. So each cell finds all links of its own
vectors without another cell. Large cells are joined in pairs of blocks.

Equal vectors collapse to one with a number of copies before anything is
dealt, and links are counted in their cell and never leave it one by one; only
a spanning forest does. Products are taken in single precision, and in double
precision where that is too close to the threshold to tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import free_name, prepared, quoted, stored
from gaitworks.llm.components import components
from gaitworks.llm.groups import by_group
from gaitworks.llm.topk import usable

#: Vectors for each pivot, and pivots at most.
CELL, PIVOTS = 8192, 1024
#: Widths of vectors that get pivots, the most frequent ones; the vectors of any other width are one cell.
WIDTHS = 64
#: Own vectors, and members, of a block at most (fewer if they are wide); products at a time.
OWN_BLOCK, MEMBER_BLOCK, STEP = 8192, 16384, 256
BLOCK_VALUES = 1 << 22
#: More than single precision can be off.
MARGIN = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(1, keepdims=True))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return flat[bounds[0] : bounds[-1]].reshape(len(lists), -1 if width is None else width).astype(np.float64)


def homes(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest pivot of each unit vector, its angle, and all cosines."""
    cosines = vectors @ pivots.T
    home = cosines.argmax(1)
    return home, np.arccos(np.clip(cosines[np.arange(len(home)), home], -1.0, 1.0)), cosines


def reached(home: np.ndarray, cosines: np.ndarray, pivots: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
    """Which cells may hold a vector within ``reach`` (an angle); the own cell always does."""
    angles = np.arccos(np.clip(cosines, -1.0, 1.0))
    near = angles <= radii[None, :] + reach + 1e-6
    apart = np.sqrt(np.maximum(2.0 - 2.0 * pivots @ pivots.T, 0.0))[home]
    rows = np.arange(len(home))
    near &= (cosines[rows, home][:, None] - cosines) <= np.sin(reach) * apart + 1e-6
    near[rows, home] = True
    return near


def block_links(own: np.ndarray, members: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of both sides, some rows of ``own`` at a time."""
    single = members.astype(np.float32)
    for at in range(0, len(own), STEP):
        products = own[at : at + STEP].astype(np.float32) @ single.T
        rows, columns = np.nonzero(products >= cosine - MARGIN)
        unsure = np.flatnonzero(products[rows, columns] < cosine + MARGIN)
        if len(unsure):
            good = np.ones(len(rows), bool)
            for part in np.array_split(unsure, -(-len(unsure) // 65536)):
                good[part] = np.einsum("ij,ij->i", own[at + rows[part]], members[columns[part]]) >= cosine
            rows, columns = rows[good], columns[good]
        yield at + rows, columns


def _links(cosine: float):
    def find(group: pa.Table) -> pa.Table | None:
        mine = np.flatnonzero(group["own"].to_numpy())
        others = np.flatnonzero(~group["own"].to_numpy())
        if not len(mine) or not len(others):
            return None
        vectors = unit(_matrix(group["v"]))
        ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        names, node = np.unique(ids, return_inverse=True)
        up = np.arange(len(names))

        def tops(x: np.ndarray) -> np.ndarray:
            """The roots of the trees that nodes are in."""
            while True:
                above = up[x]
                if (above == x).all():
                    return x
                x = above

        counts = np.zeros(len(mine), np.int64)
        for rows, columns in block_links(vectors[mine], vectors[others], cosine):
            counts += np.bincount(rows, weights=copies[others[columns]], minlength=len(mine)).astype(np.int64)
            a, b = node[mine[rows]], node[others[columns]]
            while True:
                x, y = tops(a), tops(b)
                differ = x != y
                if not differ.any():
                    break
                a, b, x, y = a[differ], b[differ], x[differ], y[differ]
                # every tree hooks onto the least tree it touches; ties of hooks settle in the next turn
                np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            up = tops(np.arange(len(names)))
        top = up
        joined = np.flatnonzero(top != np.arange(len(names)))
        kind = [0] * len(mine) + [1] * len(joined)
        return pa.table(
            {
                "kind": pa.array(kind, pa.int32()),
                "a": np.concatenate((ids[mine], names[joined])),
                "b": np.concatenate((counts, names[top[joined]])),
            }
        )

    return find


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", values: str = "embedding") -> DataFrame:
    """Every row with ``n_links`` (other rows linked directly), ``component_id`` (least vec_id of its group) and ``kept``.

    Two rows are linked if the cosine of their vectors is ``cosine`` or more.
    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and neither do vectors of different widths. Repeated
    rows link with each other. A null vec_id counts as greater than all
    others. An empty table gives no rows. Columns of the input with a result's
    name are replaced.
    """
    spark = prepared(vectors.sparkSession)
    label, results = "vectors", ("n_links", "component_id", "kept")
    value = quoted(values)
    good = usable(value) & F.exists(value, lambda x: x != 0)

    def keys(column: Column) -> tuple[Column, Column]:
        return F.xxhash64(column), F.xxhash64(F.lit(7), column)

    k1, k2 = keys(value)
    rows = vectors.filter(good).select(quoted(vec_id).cast("long").alias("vec"), k1.alias("k1"), k2.alias("k2"), value.alias("v"))
    distinct = rows.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.min("vec").alias("vec"), F.count("*").alias("copies"))
    distinct = stored(distinct.select("*", F.monotonically_increasing_id().alias("id"), F.size("v").alias("width")), f"{label}-distinct")

    sizes = distinct.groupBy("width").count().orderBy(F.desc("count"), "width").limit(WIDTHS).collect()
    reach = float(np.arccos(np.clip(cosine, -1.0, 1.0)))
    pivots: dict[int, np.ndarray] = {}
    for row in sizes:
        wanted = min(max(-(-row["count"] // CELL), 1), PIVOTS)
        chosen = distinct.filter(F.col("width") == row["width"]).orderBy(F.xxhash64("k1", "k2")).limit(wanted).select("v").toArrow()
        pivots[row["width"]] = unit(_matrix(chosen["v"]))
    held = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            home, angle = np.zeros(len(widths), np.int64), np.zeros(len(widths))
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                if width in held.value:
                    home[at], angle[at], _ = homes(unit(_matrix(batch.column(1).take(pa.array(at)))), held.value[width])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(home), pa.array(angle)], names=["id", "width", "home", "angle"]
            )

    located = distinct.select("id", "v", "width").mapInArrow(placed, "id long, width int, home long, angle double")
    cells = located.groupBy("width", "home").agg(F.max("angle").alias("radius"), F.count("*").alias("own"))
    radii = {width: np.full(len(p), -10.0) for width, p in pivots.items()}
    for row in cells.filter(F.col("width").isin(list(pivots))).collect() if pivots else []:
        radii[row["width"]][row["home"]] = row["radius"]
    known = spark.sparkContext.broadcast(radii)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            row, cell, own = [], [], []
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                if width in held.value:
                    home, _, cosines = homes(unit(_matrix(batch.column(1).take(pa.array(at)))), held.value[width])
                    near = reached(home, cosines, held.value[width], known.value[width], reach)
                else:
                    home, near = np.zeros(len(at), np.int64), np.ones((len(at), 1), bool)
                which, into = np.nonzero(near)
                row += [at, at[which]]
                cell += [home, into]
                own += [np.ones(len(at), bool), np.zeros(len(which), bool)]
            if row:
                chosen = pa.array(np.concatenate(row))
                columns = [batch.column(i).take(chosen) for i in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.concatenate(cell).astype(np.int64)), pa.array(np.concatenate(own))],
                    names=["id", "v", "width", "copies", "cell", "own"],
                )

    kind = distinct.schema["v"].dataType.simpleString()
    members = distinct.select("id", "v", "width", "copies").mapInArrow(
        spread, f"id long, v {kind}, width int, copies long, cell long, own boolean"
    )
    members = stored(members, f"{label}-members")
    most = F.greatest(F.lit(BLOCK_VALUES) / F.col("width"), F.lit(64))
    counts = members.groupBy("width", "cell").agg(
        F.ceil(F.count(F.when(F.col("own"), 1)) / F.least(F.lit(OWN_BLOCK), F.first(most))).alias("owns"),
        F.ceil(F.count(F.when(~F.col("own"), 1)) / F.least(F.lit(MEMBER_BLOCK), F.first(most))).alias("others"),
    )
    # with all widths known, a row for each pivot at most
    sized = members.join(F.broadcast(counts) if len(sizes) < WIDTHS else counts, ["width", "cell"])
    mark = F.xxhash64("id")

    def upto(count: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)

    rows_of = F.when(F.col("own"), F.transform(upto("others"), lambda j: F.struct(F.pmod(mark, F.col("owns")).alias("i"), j.alias("j")))).otherwise(
        F.transform(upto("owns"), lambda i: F.struct(i.alias("i"), F.pmod(mark, F.col("others")).alias("j")))
    )
    dealt = sized.select("width", "cell", F.explode(rows_of).alias("at"), "id", "v", "copies", "own")
    dealt = dealt.select("width", "cell", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "id", "v", "copies", "own")
    found = stored(by_group(dealt, ["width", "cell", "i", "j"], _links(cosine), "kind int, a long, b long"), f"{label}-links")

    linked = found.filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    groups = components(found.filter("kind = 1").select("a", "b"))
    named = distinct.join(linked, "id", "left").join(groups, distinct["id"] == groups["node"], "left")
    named = named.select("k1", "k2", "vec", "links", F.coalesce("component", "id").alias("g"))
    least = stored(named.groupBy("g").agg(F.min("vec").alias("least")), f"{label}-least")
    inner = [free_name(vectors.columns, name) for name in ("k1", "k2", "links", "least")]
    answer = stored(named.join(least, "g").select("k1", "k2", F.col("links") - 1, "least").toDF(*inner), f"{label}-answer")

    d1, d2 = keys(value)
    keyed = vectors.select("*", F.when(good, d1).alias(inner[0]), F.when(good, d2).alias(inner[1]))
    joined = keyed.join(answer, inner[:2], "left")
    own, group = quoted(vec_id).cast("long"), F.col(inner[3])
    component = F.when(F.col(inner[2]).isNotNull(), group).otherwise(own)
    return joined.select(
        *[quoted(c) for c in vectors.columns if c.lower() not in results],
        F.coalesce(inner[2], F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.when(component.isNull(), F.lit(True)).otherwise(F.coalesce(own == component, F.lit(False))).alias("kept"),
    )
