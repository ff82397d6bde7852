"""Products of matrices given as coordinate tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.operators.joins import join_stored
from gaitworks.session import stored

TILE = 128
#: Tiles of either side, of one range of k, that a task multiplies with each other; more are cut into a grid.
GRID_TILES = 32


def _tile_of(place: str, tile: int) -> Column:
    return F.call_function("div", F.col(place) - F.pmod(F.col(place), F.lit(tile)), F.lit(tile))


def _tiles(cells: DataFrame, row: str, column: str, side: str, tile: int) -> DataFrame:
    """Square tiles, each an array of its cells: at most ``tile * tile``, as equal cells are summed first.

    That sum starts on the map side, so a cell that is listed very often does
    not travel row by row.
    """
    placed = cells.select(
        _tile_of(row, tile).alias(f"{side}_row"),
        _tile_of(column, tile).alias(f"{side}_col"),
        (F.pmod(F.col(row), F.lit(tile)) * tile + F.pmod(F.col(column), F.lit(tile))).cast("int").alias("_at"),
        F.col("v").cast("double").alias("_v"),
    )
    return (
        placed.groupBy(f"{side}_row", f"{side}_col", "_at")
        .agg(F.sum("_v").alias("_v"))
        .groupBy(f"{side}_row", f"{side}_col")
        .agg(F.collect_list("_at").alias(f"{side}_at"), F.collect_list("_v").alias(f"{side}_v"))
    )


def grids(left: DataFrame, right: DataFrame, tile: int = TILE, grid_tiles: int = GRID_TILES) -> DataFrame:
    """``k, down, across`` of the ranges of k with more than ``grid_tiles`` tiles on a side: parts of the left and right ones."""
    sides = [
        cells.select(_tile_of("k", tile).alias("k"), _tile_of(other, tile).alias("_tile"), F.lit(name).alias("_side")).distinct()
        for cells, other, name in ((left, "i", "left"), (right, "j", "right"))
    ]
    counts = sides[0].unionByName(sides[1]).groupBy("k").agg(
        *[F.ceil(F.count_if(F.col("_side") == name) / grid_tiles).alias(part) for name, part in (("left", "down"), ("right", "across"))]
    )
    return counts.where("down > 1 OR across > 1")


def matrix_product(left: DataFrame, right: DataFrame, tile: int = TILE, grid_tiles: int = GRID_TILES) -> DataFrame:
    """``i, j, v`` of left (``i, k, v``) times right (``k, j, v``); cells without any product are absent.

    Tiles that share a range of k are joined and multiplied with NumPy, and
    the partial cells are summed before the last shuffle. The join thus
    handles pairs of tiles, not pairs of cells. A range of k with many tiles,
    as all are where the inner dimension is small, becomes a grid of
    ``down`` times ``across`` tasks, as its tile counts ask for: a left tile is
    copied to the ``across`` tasks of its row of the grid, a right tile to the
    ``down`` ones of its column. Where there are few tiles nothing is copied.
    """

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("l_row", "r_col")]
            arrays = [batch[name] for name in ("l_at", "l_v", "r_at", "r_v")]
            for n, (top, side) in enumerate(zip(*columns)):
                l_at, l_v, r_at, r_v = (column[n].values.to_numpy(zero_copy_only=False) for column in arrays)
                a, b = np.zeros(tile * tile), np.zeros(tile * tile)
                a[l_at], b[r_at] = l_v, r_v
                product = (a.reshape(tile, tile) @ b.reshape(tile, tile)).reshape(-1)
                if len(l_at) == len(r_at) == tile * tile:
                    met = np.arange(tile * tile)
                else:
                    filled_a, filled_b = np.zeros(tile * tile), np.zeros(tile * tile)
                    filled_a[l_at], filled_b[r_at] = 1, 1
                    met = np.flatnonzero(filled_a.reshape(tile, tile) @ filled_b.reshape(tile, tile))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(top * tile + met // tile, pa.int64()),
                        pa.array(side * tile + met % tile, pa.int64()),
                        pa.array(product[met]),
                    ],
                    ["i", "j", "v"],
                )

    lefts = _tiles(left, "i", "k", "l", tile)
    rights = _tiles(right, "k", "j", "r", tile)
    large = stored(grids(left, right, tile, grid_tiles), "grids")
    keys = ["k"]
    lefts, rights = lefts.withColumnRenamed("l_col", "k"), rights.withColumnRenamed("r_row", "k")
    if not large.isEmpty():
        keys = ["k", "_down", "_across"]
        lefts = _dealt(lefts, large, "l_row", "_down", "down", "_across", "across")
        rights = _dealt(rights, large, "r_col", "_across", "across", "_down", "down")
    pairs = lefts.join(rights, keys).select("l_row", "r_col", "l_at", "l_v", "r_at", "r_v")
    partial = pairs.mapInArrow(multiply, "i long, j long, v double")
    return partial.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _dealt(tiles: DataFrame, large: DataFrame, by: str, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
    """Tiles with their part of the grid along their own side, once for each part along the other side."""
    placed = join_stored(tiles, large, ["k"], F.col(by), "left")
    one = F.lit(1).cast("long")
    part = F.pmod(F.xxhash64(by), F.coalesce(own_count, one)).alias(own)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other_count, one) - 1)).alias(other)
    return placed.select(*tiles.columns, part, copies)


def checksum(cells: DataFrame) -> DataFrame:
    return cells.agg(F.sum("v").alias("checksum"))
