"""Project trees as rows of relative path and base64 content."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.sources import listing, storage

# The folder names left out of a project.
EXCLUDED = (".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".ipynb_checkpoints", "wandb")


def is_packaged(path: Column) -> Column:
    """Whether a relative path has no hidden part and no excluded name."""
    return ~F.exists(F.split(path, "/"), lambda part: part.startswith(".") | part.isin(*EXCLUDED))


def manifest(files: DataFrame) -> DataFrame:
    """``path, content`` of the packaged files, the binary content as base64 text on one line."""
    content = F.translate(F.base64("content"), "\r\n", "")
    return files.where(is_packaged(F.col("path"))).select("path", content.alias("content"))


def walk(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """``root, path`` of all files below the roots, the paths relative to them.

    Spark's own listing leaves out names that start with an underscore, such
    as ``__init__.py``.
    """
    starts = F.create_map(*[F.lit(x) for root in roots for x in (root, len(storage.base_of(root)) + 1)])
    found = listing.walk(spark, roots)
    return found.select("root", F.substring("path", F.element_at(starts, F.col("root")), F.length("path")).alias("path"))


def project_manifest(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """``path, content`` of a project tree; files that cannot be read are left out."""

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, path in zip(batch["root"].to_pylist(), batch["path"].to_pylist()):
                system, inner = storage.resolve(place)
                try:
                    with system.open_input_stream(f"{inner.rstrip('/')}/{path}", compression=None) as stream:
                        content = stream.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pydict({"path": [path], "content": [content]})

    listed = walk(spark, [storage.absolute(root)]).where(is_packaged(F.col("path")))
    spread = listed.repartition(tasks or spark.sparkContext.defaultParallelism, "path")
    return manifest(spread.mapInArrow(load, "path string, content binary"))
