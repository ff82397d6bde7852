"""Listings of folder trees, level by level, so that a tree is listed by many tasks."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.session import stored
from gaitworks.sources import storage

#: Deeper trees are taken for links that lead back up.
DEEPEST = 256
_BATCH = 10_000


def walk(spark: SparkSession, roots: Sequence[str], deep: bool = True) -> DataFrame:
    """``root, path`` of the files below the roots; hidden names and those with an underscore are there, too.

    The folders of a level are dealt to tasks, and a task lists a folder at a
    time. ``deep`` false stays on the first level.
    """

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, folder in zip(batch["root"].to_pylist(), batch["path"].to_pylist()):
                found = ((path, below) for path, below in storage.entries(folder) if deep or not below)
                # a batch at a time, however many names a folder holds
                while part := list(itertools.islice(found, _BATCH)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([root] * len(part), pa.string()),
                            pa.array([path for path, _ in part], pa.string()),
                            pa.array([below for _, below in part], pa.bool_()),
                        ],
                        ["root", "path", "folder"],
                    )

    tasks = spark.sparkContext.defaultParallelism * 4
    level = spark.createDataFrame([(root, root) for root in roots], "root string, path string")
    whole: DataFrame | None = None
    for _ in range(DEEPEST):
        spread = level.repartition(len(roots) if whole is None else tasks, "path")
        listed = stored(spread.mapInArrow(expand, "root string, path string, folder boolean"), "listing")
        files = listed.where(~F.col("folder")).select("root", "path")
        whole = files if whole is None else whole.unionByName(files)
        level = listed.where("folder").select("root", "path")
        if not deep or level.isEmpty():
            return whole
    raise RecursionError(f"more than {DEEPEST} levels of folders below {list(roots)}")
