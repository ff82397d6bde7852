"""Recordings as a data source of the engine: planned partitions that spare the files and samples nobody asked for.

The headers are read by tasks first, and the splits that come from them are a
small table in the shared folder. Planning a query reads that table, leaves out
the files and samples that were not asked for, and hands each task its run of
splits. Only the members named in the schema are opened.

Which files, samples and fields to read is said when the source is opened. The
engine could hand filters to a Python source, but it keeps one state for a
source however often a query, or several, read it: the filters of one scan then
cut the rows of another. It does not tell which columns a query uses.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gaitworks.session import scratch_path, ship_package
from gaitworks.sources import recordings, storage

NAME = "npz_recordings"


@dataclass
class Splits(InputPartition):
    """The splits of one task, in order."""

    splits: list[dict]


class Recordings(DataSource):
    """Options: ``splits``, a table of ``file_idx, path, start, end, _task``; as JSON ``trim``, ``files`` and ``samples``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give a schema of file_idx, sample_idx and the fields to read")

    def reader(self, schema: StructType) -> DataSourceReader:
        option = {name: json.loads(self.options.get(name, default)) for name, default in (("trim", "{}"), ("files", "null"), ("samples", "null"))}
        return Reader(schema.names, self.options["splits"], **option)


class Reader(DataSourceReader):
    """``files`` are indices, ``samples`` a range of places in each file (end excluded); none is all of them."""

    def __init__(self, names: list[str], splits: str, trim: dict[str, list[int]], files: list[int] | None = None, samples: list[int] | None = None):
        if names[:2] != ["file_idx", "sample_idx"]:
            raise ValueError(f"the schema starts with file_idx and sample_idx, not {names[:2]}")
        self.fields, self.splits = names[2:], splits
        self.cuts = [tuple(trim.get(field, ())) for field in self.fields]
        self.files = None if files is None else set(files)
        self.samples = samples or [0, math.inf]

    def partitions(self) -> Sequence[InputPartition]:
        tasks: dict[int, list[dict]] = {}
        least, most = self.samples
        for part in sorted(storage.list_dir(self.splits)):
            if not part.endswith(".parquet"):
                continue
            system, inner = storage.resolve(part)
            with system.open_input_file(inner) as raw:
                for batch in parquet.ParquetFile(raw).iter_batches():
                    for split in batch.to_pylist():
                        start, end = max(split["start"], least), min(split["end"], most)
                        if start < end and (self.files is None or split["file_idx"] in self.files):
                            tasks.setdefault(split.pop("_task"), []).append({**split, "start": start, "end": end})
        return [Splits(sorted(tasks[task], key=lambda s: (s["file_idx"], s["start"]))) for task in sorted(tasks)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        # a plan without partitions is still asked for one
        for split in partition.splits if isinstance(partition, Splits) else ():
            yield from recordings.decode(split, self.fields, self.cuts)


def open_recordings(
    profiled: DataFrame,
    fields: Sequence[str],
    trim: dict[str, tuple[int, ...]] | None = None,
    files: Sequence[int] | None = None,
    samples: tuple[int, int] | None = None,
    split_bytes: int = recordings.SPLIT_BYTES,
) -> DataFrame:
    """What ``read_recordings`` gives, in the same order, of some files and some samples of each.

    ``files`` are values of ``file_idx``; ``samples`` is a range of
    ``sample_idx``, its end excluded. Other files are not opened, and
    uncompressed members are read by seeking to the samples.
    """
    spark = profiled.sparkSession
    ship_package(spark)
    splits, ranks, _ = recordings.planned(profiled, fields, split_bytes)
    place = scratch_path(spark, "splits")
    # a row per split, of which a task has megabytes to read
    splits.select("file_idx", "path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "_task").write.parquet(place)
    spark.dataSource.register(Recordings)
    options = {
        "trim": {name: list(cut) for name, cut in (trim or {}).items()},
        "files": None if files is None else [int(x) for x in files],
        "samples": None if samples is None else [int(x) for x in samples],
    }
    reader = spark.read.format(NAME).schema(recordings.schema_of(fields, ranks)).option("splits", place)
    return reader.options(**{name: json.dumps(value) for name, value in options.items()}).load()
