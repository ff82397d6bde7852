"""Work on groups of rows that are bounded in size, many to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each key, which must be few enough for a task's memory.

    Rows are dealt and sorted by key, and a task goes through its groups as a
    stream: a small group costs no call of its own into Python.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    places = [df.columns.index(key) for key in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, places):
            result = work(group)
            if result is not None:
                yield from result.to_batches()

    return dealt.mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], places: list[int]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = None
        for place in places:
            column = batch.column(place)
            differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
            change = differs if change is None else pc.or_(change, differs)
        cuts = [i + 1 for i in pc.indices_nonzero(change).to_pylist()] if batch.num_rows > 1 else []
        if held and any(batch.column(p)[0] != held[0].column(p)[0] for p in places):
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *cuts, batch.num_rows]
        for start, end in zip(bounds[:-1], bounds[1:]):
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
