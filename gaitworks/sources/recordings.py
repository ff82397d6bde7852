"""Recordings: one NPZ file of arrays per recording, all with the sample as first axis.

Listing, header reading and decoding run in tasks. A file is described by its
member headers first (``profile``), from which come the checks, the schema and
the splits; a split is a range of samples, so that one huge file is read by
many tasks. Members that NumPy stored uncompressed are read by seeking.
Deflated members can only be read from their start, so such a file is one
split, read in a stream.
"""

from __future__ import annotations

import math
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.functions.text import path_name
from gaitworks.operators.indexing import cap_files, global_index, with_offsets
from gaitworks.session import materialized
from gaitworks.sources import listing, storage

SPLIT_BYTES = 128 << 20
BATCH_BYTES = 8 << 20
#: What opening a split costs, in bytes read.
OPEN_COST = 1 << 20

PROFILE_SCHEMA = (
    "file_idx long, name string, path string, num_bytes long, "
    "fields map<string, struct<dtype: string, shape: array<long>, stored: boolean, column_order: boolean>>"
)


def list_recordings(
    spark: SparkSession,
    folder: str | None = None,
    pattern: str | None = None,
    files: Sequence[str] = (),
    max_files: int | None = None,
) -> DataFrame:
    """``file_idx, name, path`` of the union of folder, pattern and listed files, by path, without doubles.

    The folder is not searched below its first level. Indices are dense, in path order.
    """
    if not (folder or pattern or files):
        raise ValueError("give a folder, a pattern or files")
    found = spark.createDataFrame([(storage.absolute(path),) for path in files], "path string")
    if folder:
        below = listing.walk(spark, [storage.absolute(folder)], deep=False)
        found = found.unionByName(below.where(F.col("path").endswith(".npz")).select("path"))
    if pattern:
        root, wanted, deep = storage.glob_root(storage.absolute(pattern))
        base = storage.base_of(root)

        def matching(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matches = re.compile(wanted).match
            for batch in batches:
                yield from _text_batches("path", (p for p in batch["path"].to_pylist() if matches(p.removeprefix(base))))

        found = found.unionByName(listing.walk(spark, [root], deep).select("path").mapInArrow(matching, "path string"))

    def canonical(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _text_batches("path", map(storage.canonical, batch["path"].to_pylist()))

    paths = found.mapInArrow(canonical, "path string").distinct()
    indexed = global_index(paths, ["path"], "file_idx")
    if indexed.isEmpty():
        raise FileNotFoundError("no recordings found")
    return cap_files(indexed.select("file_idx", path_name(F.col("path")).alias("name"), "path"), max_files)


def _text_batches(name: str, values: Iterable[str], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    block: list[str] = []
    for value in values:
        block.append(value)
        if len(block) == size:
            yield pa.RecordBatch.from_pydict({name: pa.array(block, pa.string())})
            block = []
    if block:
        yield pa.RecordBatch.from_pydict({name: pa.array(block, pa.string())})


def _header(member) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(member)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(member)


def profile(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per file: its members' names, types and shapes, from the headers alone.

    The result is checkpointed, so that the checks and the reader, which all
    start from it, open each file's header once.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                fields = []
                system, inner = storage.resolve(row["path"])
                with system.open_input_file(inner) as raw, zipfile.ZipFile(raw) as archive:
                    for info in archive.infolist():
                        if not info.filename.endswith(".npy"):
                            continue
                        with archive.open(info) as member:
                            shape, column_order, dtype = _header(member)
                        described = {
                            "dtype": dtype.str,
                            "shape": list(shape),
                            "stored": info.compress_type == zipfile.ZIP_STORED,
                            "column_order": bool(column_order and len(shape) > 1),
                        }
                        fields.append((info.filename.removesuffix(".npy"), described))
                    size = raw.size()
                rows.append({**row, "num_bytes": size, "fields": fields})
            yield pa.RecordBatch.from_pylist(rows, schema=_PROFILE_ARROW)

    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = tasks or cores * 4
    named = files.select("file_idx", "name", "path").repartition(tasks, "file_idx")
    # headers wait for storage, in many tasks; what is made of them is small, and many jobs read it
    return materialized(named.mapInArrow(read, PROFILE_SCHEMA)).coalesce(min(tasks, cores))


_PROFILE_ARROW = pa.schema(
    [
        ("file_idx", pa.int64()),
        ("name", pa.string()),
        ("path", pa.string()),
        ("num_bytes", pa.int64()),
        (
            "fields",
            pa.map_(
                pa.string(),
                pa.struct(
                    [
                        ("dtype", pa.string()),
                        ("shape", pa.list_(pa.int64())),
                        ("stored", pa.bool_()),
                        ("column_order", pa.bool_()),
                    ]
                ),
            ),
        ),
    ]
)


def files_table(profiled: DataFrame, counted: str = "state") -> DataFrame:
    """``file_idx, name, path, num_samples`` as the headers declare them."""
    return profiled.select(
        "file_idx", "name", "path", F.get(F.col("fields")[counted]["shape"], F.lit(0)).alias("num_samples")
    )


def read_recordings(
    profiled: DataFrame,
    fields: Sequence[str],
    trim: dict[str, tuple[int, ...]] | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """``file_idx, sample_idx`` and the named fields as float32 arrays, one row per sample.

    Only the named members are read; ``trim`` cuts a field's trailing axes
    before the values leave the decoder. The fields must be present in every
    file with one rank and with equal sample counts per file, which the
    operators in ``checks`` find out; otherwise this fails and names the file.
    Partitions come in file and sample order, so a write needs no shuffle of
    the samples.
    """
    splits, ranks, tasks = planned(profiled, fields, split_bytes)
    cuts = [(trim or {}).get(field, ()) for field in fields]
    names = list(fields)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                yield from decode(split, names, cuts)

    return (
        splits.repartitionById(tasks, "_task")
        .sortWithinPartitions("file_idx", "start")
        .drop("_task")
        .mapInArrow(read, schema_of(names, ranks))
    )


def schema_of(fields: Sequence[str], ranks: Sequence[int]) -> str:
    types = ["array<" * (rank - 1) + "float" + ">" * (rank - 1) for rank in ranks]
    return "file_idx long, sample_idx long, " + ", ".join(f"`{f}` {t}" for f, t in zip(fields, types))


def planned(profiled: DataFrame, fields: Sequence[str], split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, list[int], int]:
    """``file_idx, path, start, end, _task`` of the splits in order, the fields' ranks, and the number of tasks."""
    fields = list(fields)
    described = profiled.select(
        "file_idx", "path", *[F.col("fields")[name].alias(f"_f{i}") for i, name in enumerate(fields)]
    )
    absent = [F.when(F.col(f"_f{i}").isNull(), F.lit(name)) for i, name in enumerate(fields)]
    firsts = [F.get(F.col(f"_f{i}.shape"), F.lit(0)) for i in range(len(fields))]
    row_bytes = sum(
        (
            F.aggregate(
                F.slice(F.col(f"_f{i}.shape"), 2, F.greatest(F.size(F.col(f"_f{i}.shape")) - 1, F.lit(0))), F.lit(4).cast("long"), lambda size, width: size * width
            )
            for i in range(len(fields))
        ),
        F.lit(0),
    )
    measured = described.select(
        "file_idx",
        "path",
        F.coalesce(*absent).alias("_absent"),
        firsts[0].alias("_n"),
        row_bytes.alias("_row_bytes"),
        F.array(*firsts).alias("_firsts"),
        F.array(*[F.size(F.col(f"_f{i}.shape")) for i in range(len(fields))]).alias("_ranks"),
        F.forall(
            F.array(*[F.col(f"_f{i}.stored") & ~F.col(f"_f{i}.column_order") for i in range(len(fields))]),
            lambda seekable: seekable,
        ).alias("_seekable"),
    )
    uneven = F.exists("_firsts", lambda n: ~n.eqNullSafe(F.col("_n")))
    step = F.when(
        F.col("_seekable"), F.greatest(F.floor(F.lit(split_bytes) / F.greatest("_row_bytes", F.lit(1))), F.lit(1))
    ).otherwise(F.greatest("_n", F.lit(1)))
    measured = measured.withColumn("_step", step).withColumn(
        "_cost", F.col("_n") * F.col("_row_bytes") + F.ceil(F.col("_n") / F.col("_step")) * OPEN_COST
    )
    facts = measured.agg(
        F.min_by(F.struct("_absent", "path"), F.when(F.col("_absent").isNotNull(), F.col("file_idx"))).alias("absent"),
        F.min_by("path", F.when(F.col("_absent").isNull() & uneven, F.col("file_idx"))).alias("uneven"),
        F.collect_set(F.when(F.col("_absent").isNull(), F.col("_ranks"))).alias("ranks"),
        F.coalesce(F.sum("_cost"), F.lit(0)).alias("cost"),
        F.coalesce(F.sum(F.ceil(F.col("_n") / F.col("_step"))), F.lit(0)).alias("splits"),
    ).first()
    if facts["absent"]:
        raise KeyError(f"missing field {facts['absent']['_absent']!r} in {facts['absent']['path']}")
    if facts["uneven"]:
        raise ValueError(f"fields differ in sample count in {facts['uneven']}")
    if len(facts["ranks"]) != 1:
        raise ValueError(f"files differ in the ranks of {fields}: {facts['ranks']}")
    ranks = facts["ranks"][0]
    if 0 in ranks:
        raise ValueError(f"a field without sample axis: {dict(zip(fields, ranks))}")

    # each task gets a run of splits of about equal cost, in file and sample order
    cores = profiled.sparkSession.sparkContext.defaultParallelism
    pieces = math.ceil(facts["cost"] / split_bytes)
    tasks = max(1, min(facts["splits"], max(pieces, cores)))
    share = max(1, math.ceil(facts["cost"] / tasks))
    placed = with_offsets(measured.where(F.col("_n") > 0), value="_cost", name="_at")
    splits = (
        placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.col("_step"))).alias("start"))
        .withColumn("end", F.least(F.col("start") + F.col("_step"), F.col("_n")))
        .withColumn(
            "_at", F.col("_at") + F.col("start") * F.col("_row_bytes") + F.col("start") / F.col("_step") * OPEN_COST
        )
        .select("file_idx", "path", "start", "end", F.floor(F.col("_at") / share).cast("int").alias("_task"))
    )
    return splits, ranks, tasks


def decode(split: dict, fields: list[str], cuts: list[tuple[int, ...]]) -> Iterator[pa.RecordBatch]:
    """Stream one split as record batches of a few megabytes."""
    system, inner = storage.resolve(split["path"])
    with system.open_input_file(inner) as raw, zipfile.ZipFile(raw) as archive:
        members = [_Member(archive, name, split["start"]) for name in fields]
        rows = max(1, BATCH_BYTES // max(1, sum(member.row_bytes for member in members)))
        for first in range(split["start"], split["end"], rows):
            count = min(rows, split["end"] - first)
            columns = [
                pa.array(np.full(count, split["file_idx"], np.int64)),
                pa.array(np.arange(first, first + count, dtype=np.int64)),
            ]
            for member, cut in zip(members, cuts):
                block = member.read(count)
                for axis, width in enumerate(cut, start=1):
                    block = block[(slice(None),) * axis + (slice(0, width),)]
                columns.append(nested_array(np.ascontiguousarray(block, dtype=np.float32)))
            yield pa.RecordBatch.from_arrays(columns, ["file_idx", "sample_idx", *fields])


class _Member:
    """Rows of one archive member, read forward from a start row."""

    def __init__(self, archive: zipfile.ZipFile, name: str, start: int):
        self.name = name
        self.stream = archive.open(f"{name}.npy")
        self.shape, column_order, self.dtype = _header(self.stream)
        if self.dtype.hasobject:
            raise ValueError(f"field {name!r} holds objects, which are not read")
        self.row_bytes = self.dtype.itemsize * math.prod(self.shape[1:])
        self.whole = None
        if column_order and len(self.shape) > 1:
            # the sample axis is scattered over the whole member
            data = np.frombuffer(self._take(self.row_bytes * self.shape[0]), self.dtype)
            self.whole = data.reshape(self.shape, order="F")
        elif start:
            self.stream.seek(self.stream.tell() + start * self.row_bytes)
        self.at = start

    def _take(self, size: int) -> bytes:
        data = self.stream.read(size)
        if len(data) != size:
            raise ValueError(f"field {self.name!r} ends early")
        return data

    def read(self, count: int) -> np.ndarray:
        first, self.at = self.at, self.at + count
        if self.whole is not None:
            return self.whole[first : self.at]
        return np.frombuffer(self._take(count * self.row_bytes), self.dtype).reshape(count, *self.shape[1:])


def nested_array(block: np.ndarray) -> pa.Array:
    """A dense block as Arrow lists nested by its rank, one entry per row."""
    out = pa.array(block.reshape(-1))
    for axis in range(block.ndim - 1, 0, -1):
        rows = math.prod(block.shape[:axis])
        offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(block.shape[axis])
        out = pa.ListArray.from_arrays(pa.array(offsets), out)
    return out
