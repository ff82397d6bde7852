"""Datasets as Parquet: ``samples``, ``files`` and ``dataset_meta`` in a version folder below the dataset's own.

A write goes to a version folder of its own, the meta table last. Its success
mark is what makes the version count: readers take the newest whole version, so
a write that fails, at whatever point, leaves the dataset as it was, and a
reader that has opened a version keeps it while the next one is written. The
version before the newest stays for such readers; older ones go with the next
write. Datasets without versions (the three tables right below the folder) are
read, too. One writer at a time.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.functions.text import path_stem
from gaitworks.operators.checks import raise_if_any, reconcile
from gaitworks.operators.indexing import attach_offset, with_offsets
from gaitworks.operators.joins import join_lookup
from gaitworks.session import setting, stored
from gaitworks.sources import storage

SAMPLES, FILES, META = "samples", "files", "dataset_meta"
PART_ROWS = 16_384

# Parquet codecs for the compression names.
CODECS = {"none": "uncompressed", "lzf": "snappy", "gzip": "gzip"}
# The zlib level names by number.
ZLIB_LEVELS = (
    "NO_COMPRESSION",
    "BEST_SPEED",
    "TWO",
    "THREE",
    "FOUR",
    "FIVE",
    "SIX",
    "SEVEN",
    "EIGHT",
    "BEST_COMPRESSION",
)


def compression_options(name: str, level: int | None = None, strict: bool = True) -> dict[str, str]:
    """Writer options of a compression name; an unknown name is an error, or gzip when not strict."""
    if name not in CODECS:
        if strict:
            raise ValueError(f"unknown compression {name!r}; known are {sorted(CODECS)}")
        name = "gzip"
    # measured floats hardly repeat: without trying a dictionary first, writes take a quarter less time
    options = {"compression": CODECS[name], "parquet.enable.dictionary": "false"}
    if name == "gzip" and level is not None:
        options["zlib.compress.level"] = ZLIB_LEVELS[level]
    return options


@dataclass(frozen=True)
class Dataset:
    """``path`` is the dataset's folder, ``folder`` that of the version that was opened."""

    samples: DataFrame
    files: DataFrame
    meta: DataFrame
    path: str
    folder: str

    def meta_dict(self) -> dict[str, str]:
        """The recorded parameters, a handful of rows."""
        return {row["key"]: row["value"] for row in self.meta.collect()}


def meta_table(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    rows = [(key, str(value)) for key, value in values.items()]
    return spark.createDataFrame(rows, "key string, value string").coalesce(1)


_VERSION = re.compile(r"v(\d{6,})-[0-9a-f]{8}")


def versions(path: str) -> list[tuple[int, str, bool]]:
    """``number, folder, whole`` of the versions below a dataset's folder, oldest first; a dataset without versions is number 0."""
    _, folders = storage.list_both(path)
    found = []
    for name in (folder.rstrip("/").rsplit("/", 1)[1] for folder in folders):
        match = _VERSION.fullmatch(name)
        if match:
            found.append((int(match[1]), f"{path}/{name}", storage.exists(f"{path}/{name}/{META}/_SUCCESS")))
    if storage.exists(f"{path}/{META}/_SUCCESS"):
        found.append((0, path, True))
    return sorted(found)


def current(path: str) -> str:
    """The folder of the newest whole version."""
    whole = [folder for _, folder, done in versions(path) if done]
    if not whole:
        raise FileNotFoundError(f"no whole dataset at {path}: it has no {META}")
    return whole[-1]


def _new_version(path: str, overwrite: bool) -> str:
    if not overwrite and storage.exists(path):
        raise FileExistsError(f"output exists: {path}")
    number = max((number for number, _, _ in versions(path)), default=0) + 1
    return f"{path}/v{number:06d}-{uuid.uuid4().hex[:8]}"


def _clear_older(spark: SparkSession, path: str, newest: str) -> None:
    """Delete what is older than the whole version before the newest, and unfinished versions before the newest."""
    older = [version for version in versions(path) if version[1] != newest]
    kept = next((folder for _, folder, done in reversed(older) if done), None)
    for _, folder, _ in older:
        if folder != kept:
            for place in [f"{path}/{name}" for name in (SAMPLES, FILES, META)] if folder == path else [folder]:
                target = spark._jvm.org.apache.hadoop.fs.Path(place)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _read(spark: SparkSession, *paths: str) -> DataFrame:
    """A table of any number of folders, listed by a few tasks for each core.

    Left alone, the engine lists up to 10,000 folders with a task for each, and
    starting a task takes far longer than listing a shard.
    """
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", _few_tasks(spark)):
        return spark.read.parquet(*paths)


def _few_tasks(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism * 4


def write_consolidated(
    samples: DataFrame,
    files: DataFrame,
    path: str,
    meta: dict[str, object] | None = None,
    overwrite: bool = True,
    compression: str = "none",
    level: int | None = None,
    verify: bool = True,
    in_order: bool = False,
    part_rows: int = PART_ROWS,
) -> Dataset:
    """All files in path order in one dataset.

    Each part gets the same number of rows by their place over all files, so
    that a file of any size spreads over as many parts as it needs, and
    readers skip by footer statistics. The place comes from the offsets in
    ``files``, which spares the second pass that sampling for ranges costs.
    ``in_order`` says that the rows come so already, as the reader
    of recordings and ``derive`` with offsets give them; they are then
    written without a shuffle. Row counts are compared with ``files`` after
    the write.
    """
    spark = samples.sparkSession
    target = _new_version(path, overwrite)
    if "file_offset" not in files.columns:
        files = with_offsets(files)
    if not in_order:
        samples = _in_parts(samples, files, part_rows)
    samples.write.options(**compression_options(compression, level)).parquet(f"{target}/{SAMPLES}")
    return _finish(spark, files, path, target, meta or {}, verify)


def _in_parts(samples: DataFrame, files: DataFrame, part_rows: int) -> DataFrame:
    """Rows in global order, cut into parts of equal length."""
    total = files.agg(F.coalesce(F.sum("num_samples"), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / part_rows))
    # a row of a file that is not listed goes to the first part, for the verification to find
    placed = join_lookup(samples, files.select("file_idx", "file_offset"), ["file_idx"], F.col("sample_idx"), "left")
    part = F.call_function("div", F.col("file_offset") + F.col("sample_idx"), F.lit(part_rows)).cast("int")
    return (
        placed.repartitionById(parts, part)
        .sortWithinPartitions("file_idx", "sample_idx")
        .select(*samples.columns)
    )


def _finish(spark: SparkSession, files: DataFrame, path: str, target: str, meta: dict, verify: bool) -> Dataset:
    """Side tables after the samples. The meta table goes last: a version that has it is whole, and counts from then on."""
    if "file_offset" not in files.columns:
        files = with_offsets(files)
    files.write.parquet(f"{target}/{FILES}")
    written = _read(spark, f"{target}/{SAMPLES}")
    stored = spark.read.parquet(f"{target}/{FILES}")
    if verify:
        # positions are a small part of the samples, so that a task takes those of many shards
        places = written.select("file_idx", "sample_idx").coalesce(_few_tasks(spark))
        raise_if_any(reconcile(places, stored), "rows written differ from rows declared")
    total = stored.agg(F.coalesce(F.sum("num_samples"), F.lit(0)), F.count("*")).first()
    values = {"num_samples": total[0], "source_files": total[1], **meta}
    meta_table(spark, values).write.parquet(f"{target}/{META}")
    _clear_older(spark, path, target)
    return _opened(spark, path, target, required=(), samples=written)


def write_shards(
    samples: DataFrame,
    files: DataFrame,
    path: str,
    meta: dict[str, object] | None = None,
    overwrite: bool = True,
    compression: str = "gzip",
    level: int | None = 1,
    part_rows: int | None = PART_ROWS,
    verify: bool = True,
) -> Dataset:
    """One folder per source file below ``samples``; ``files`` records it as ``shard_path``.

    A task gets whole runs of ``part_rows`` samples of a file rather than whole
    files, so a huge file is written by many tasks. Without ``part_rows`` the
    rows are written as they lie, for input that is in runs already.
    """
    target = _new_version(path, overwrite)
    if part_rows:
        run = F.call_function("div", F.col("sample_idx"), F.lit(part_rows))
        samples = samples.repartition("file_idx", run).sortWithinPartitions("file_idx", "sample_idx")
    (
        samples.write.partitionBy("file_idx")
        .options(**compression_options(compression, level))
        .parquet(f"{target}/{SAMPLES}")
    )
    shard = F.concat(F.lit(f"{target}/{SAMPLES}/file_idx="), F.col("file_idx").cast("string"))
    return _finish(samples.sparkSession, files.withColumn("shard_path", shard), path, target, meta or {}, verify)


def read_dataset(spark: SparkSession, path: str, required: tuple[str, ...] = ("action", "state")) -> Dataset:
    """Open a dataset's newest whole version; it must have the required fields and the files table's names and offsets.

    A folder in which nothing was written to the end is refused.
    """
    return _opened(spark, path, current(path), required)


def _opened(
    spark: SparkSession, path: str, folder: str, required: tuple[str, ...], samples: DataFrame | None = None
) -> Dataset:
    """``samples`` are those of the folder where they have been listed already."""
    samples = _read(spark, f"{folder}/{SAMPLES}") if samples is None else samples
    samples = samples.withColumn("file_idx", F.col("file_idx").cast("long"))
    files = spark.read.parquet(f"{folder}/{FILES}")
    meta = spark.read.parquet(f"{folder}/{META}")
    lacking = [name for name in required if name not in samples.columns]
    lacking += [name for name in ("name", "file_offset", "num_samples") if name not in files.columns]
    if lacking:
        raise KeyError(f"dataset {path} lacks {lacking}")
    total = files.agg(F.coalesce(F.sum("num_samples"), F.lit(0))).first()[0]
    # small shards share a task; large ones have more than one for each part of the samples
    tasks = max(_few_tasks(spark), math.ceil(total / PART_ROWS))
    return Dataset(samples.coalesce(tasks), files, meta, path, folder)


def rows_between(dataset: Dataset, start: int, end: int) -> DataFrame:
    """The rows of ``union_view`` with ``start <= global_row < end``, read from no more than the files and parts that hold them.

    The ends are looked up in the offsets first: each is a file and a place in
    it, and these are plain comparisons of ``file_idx`` and ``sample_idx``,
    which reach the scan. They prune shard folders, or row groups by their
    footers' bounds.
    """
    filled = dataset.files.where(F.col("num_samples") > 0).where(F.col("file_offset") < end)
    facts = filled.agg(
        F.max(F.when(F.col("file_offset") <= start, F.struct("file_offset", "file_idx"))).alias("first"),
        F.max(F.struct("file_offset", "file_idx")).alias("last"),
    ).first()
    samples = dataset.samples
    if end <= start or facts["last"] is None:
        return attach_offset(samples.where(F.lit(False)), dataset.files)
    last_file, last_row = facts["last"]["file_idx"], end - facts["last"]["file_offset"]
    first = facts["first"] or {"file_idx": None}
    index, row = F.col("file_idx"), F.col("sample_idx")
    wanted = index <= last_file
    if first["file_idx"] == last_file:
        # within one file the rows are bounded as well
        wanted = (index == last_file) & (row >= start - first["file_offset"]) & (row < last_row)
    else:
        wanted &= (index < last_file) | (row < last_row)
        if first["file_idx"] is not None:
            wanted &= (index >= first["file_idx"]) & ((index > first["file_idx"]) | (row >= start - first["file_offset"]))
    near = dataset.files.where(index <= last_file)
    return attach_offset(samples.where(wanted), near if first["file_idx"] is None else near.where(index >= first["file_idx"]))


def union_view(dataset: Dataset) -> DataFrame:
    """All shards as one table with ``global_row``; no data is rewritten."""
    return attach_offset(dataset.samples, dataset.files)


def concat_datasets(first: Dataset, second: Dataset) -> tuple[DataFrame, DataFrame]:
    """Samples and files of both, the second's file indices moved behind the first's."""
    top = first.files.agg(F.coalesce(F.max("file_idx") + 1, F.lit(0))).first()[0]

    def moved(df: DataFrame) -> DataFrame:
        return df.withColumn("file_idx", F.col("file_idx") + F.lit(top))

    files = first.files.drop("file_offset").unionByName(moved(second.files.drop("file_offset")), True)
    return first.samples.unionByName(moved(second.samples)), with_offsets(files)


def present_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Adds ``present``: whether there is a file or folder of that name.

    The folders the paths lie in are listed by tasks, each once, and joined with
    the paths; so requests grow with folders, not with paths. A null path, one
    without a folder and one spelled with a last ``.`` or ``..`` is not there.
    """
    spark = paths.sparkSession
    parent, name = F.regexp_extract(column, "^(.*)/[^/]+/*$", 1), F.regexp_extract(column, "^.*/([^/]+)/*$", 1)
    keyed = paths.withColumns({"_parent": parent, "_name": name})
    folders = keyed.select("_parent").where("_parent <> '' OR _name <> ''").distinct()

    def look(batches):
        for batch in batches:
            for folder in batch["_parent"].to_pylist():
                for names in storage.names_below(folder or "/"):
                    yield pa.RecordBatch.from_pydict({"_parent": pa.array([folder] * len(names), pa.string()), "_name": pa.array(names, pa.string())})

    tasks = spark.sparkContext.defaultParallelism * 4
    there = folders.repartition(tasks, "_parent").mapInArrow(look, "_parent string, _name string")
    there = there.withColumn("present", F.lit(True))
    found = join_lookup(keyed, there, ["_parent", "_name"], F.col("_name"), "left")
    return found.select(*paths.columns, F.coalesce("present", F.lit(False)).alias("present"))


def choose_shards(candidates: DataFrame) -> DataFrame:
    """``file_idx, path`` from the expected places if all are there, else from the recorded ones.

    ``candidates`` has ``file_idx, expected, recorded, expected_present,
    recorded_present``. With neither set whole it fails with three missing examples.
    """
    whole = candidates.agg(
        F.bool_and("expected_present").alias("expected"),
        F.bool_and(F.col("recorded_present") & F.col("recorded").isNotNull()).alias("recorded"),
    ).first()
    if whole["expected"]:
        return candidates.select("file_idx", F.col("expected").alias("path"))
    if whole["recorded"]:
        return candidates.select("file_idx", F.col("recorded").alias("path"))
    lost = missing_shards(candidates).orderBy("file_idx").limit(3).collect()
    raise FileNotFoundError(f"shards not found; missing examples: {[row['path'] for row in lost]}")


def missing_shards(candidates: DataFrame) -> DataFrame:
    return candidates.where(~F.col("expected_present")).select("file_idx", F.col("expected").alias("path"))


def resolve_shards(files: DataFrame, shard_dir: str, suffix: str | None = None) -> DataFrame:
    """Where each file's shard is: in ``shard_dir`` or else at its recorded ``shard_path``.

    A shard is expected at ``file_idx=<n>``, or at ``<stem><suffix>`` when a suffix is given.
    """
    if suffix is None:
        place = F.concat(F.lit("file_idx="), F.col("file_idx").cast("string"))
    else:
        place = F.concat(path_stem(F.col("name")), F.lit(suffix))
    recorded = F.col("shard_path") if "shard_path" in files.columns else F.lit(None).cast("string")
    places = files.select(
        "file_idx", F.concat(F.lit(shard_dir.rstrip("/") + "/"), place).alias("expected"), recorded.alias("recorded")
    )
    looked = present_paths(places, "expected").withColumnRenamed("present", "expected_present")
    return choose_shards(present_paths(looked, "recorded").withColumnRenamed("present", "recorded_present"))


def materialize(
    spark: SparkSession,
    source: str,
    target: str,
    overwrite: bool = False,
    compression: str = "gzip",
    level: int | None = 1,
    shard_dir: str | None = None,
    part_rows: int = PART_ROWS,
) -> Dataset:
    """Copy a sharded dataset to one compact dataset; counts are verified and meta is carried over.

    The shards are read from ``shard_dir`` (the dataset's own folder if none is
    given) if all of them are there, else from the places the files table
    recorded. The engine scans them and writes what it reads, without a shuffle
    of the samples; small shards share a part of about ``part_rows`` samples.
    """
    if not overwrite and storage.exists(target):
        raise FileExistsError(f"output exists: {target}")
    opened = current(source)
    files = spark.read.parquet(f"{opened}/{FILES}")
    recorded = {row["key"]: row["value"] for row in spark.read.parquet(f"{opened}/{META}").collect()}
    folder = shard_dir or f"{opened}/{SAMPLES}"
    total = files.agg(F.coalesce(F.sum("num_samples"), F.lit(0))).first()[0]
    # at least a part for each core, as compressing is most of the work
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(total / part_rows))
    samples = scan_shards(resolve_shards(files, folder)).coalesce(parts)
    meta = {key: value for key, value in recorded.items() if key != "vds"}
    meta |= {"materialized_from_vds": True, "source_dataset": source, "source_shard_dir": folder}
    return write_consolidated(
        samples, files.drop("shard_path"), target, meta, overwrite, compression=compression, level=level, in_order=True
    )


def scan_shards(places: DataFrame) -> DataFrame:
    """The samples of shard folders (``file_idx, path``), by a scan of the engine's.

    Folders named ``file_idx=<n>`` are partitions of the folder they lie in,
    however many there are; of others each file's folder says whose it is.
    """
    spark = places.sparkSession
    parts = places.select("file_idx", "path", F.regexp_extract("path", "^(.*)/file_idx=([0-9]+)/*$", 1).alias("parent"))
    own = F.regexp_extract("path", "^(.*)/file_idx=([0-9]+)/*$", 2) == F.col("file_idx").cast("string")
    parts = stored(parts.withColumn("own", own), "shards")
    if parts.isEmpty():
        raise ValueError("there are no shards")
    if parts.where("NOT own").isEmpty():
        parents = [row["parent"] for row in parts.select("parent").distinct().collect()]
        found = []
        for parent in parents:
            samples = _read(spark, parent).withColumn("file_idx", F.col("file_idx").cast("long"))
            wanted = parts.where(F.col("parent") == parent).select(F.col("file_idx").cast("long").alias("file_idx"))
            # the folder may hold shards that the dataset does not name
            found.append(join_lookup(samples, wanted, ["file_idx"], F.col("sample_idx"), "left_semi"))
        whole = reduce(DataFrame.unionByName, found)
    else:
        paths = [row["path"] for row in parts.select("path").collect()]
        file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        folder = F.regexp_replace(file, "/[^/]*$", "")
        samples = _read(spark, *paths).withColumn("_folder", _plain_path(folder))
        # a folder may be spelled as a partition of another file
        samples = samples.select("_folder", *[c for c in samples.columns if c not in ("file_idx", "_folder")])
        owners = parts.select(_plain_path(F.col("path")).alias("_folder"), F.col("file_idx").cast("long").alias("file_idx"))
        whole = join_lookup(samples, owners, ["_folder"], F.col("sample_idx")).drop("_folder")
    return whole.select("file_idx", *[c for c in whole.columns if c != "file_idx"])


def _plain_path(path: Column) -> Column:
    """Without the ways of writing that a local path and a URI of it differ in."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/*", "/"), "/+$", "")


def dataset_summary(samples: DataFrame) -> DataFrame:
    """``field, num_samples, min_shape, max_shape`` per array field, in one scan."""
    arrays = [f.name for f in samples.schema if f.dataType.typeName() == "array"]
    shapes = []
    for name in arrays:
        kind = samples.schema[name].dataType.elementType.typeName()
        inner = F.size(F.get(F.col(name), F.lit(0))) if kind == "array" else None
        shape = F.array(F.size(name), inner) if inner is not None else F.array(F.size(name))
        shapes += [F.min(shape).alias(f"min_{name}"), F.max(shape).alias(f"max_{name}")]
    facts = samples.agg(F.count("*").alias("num_samples"), *shapes)
    rows = [
        F.struct(F.lit(name).alias("field"), F.col(f"min_{name}").alias("min_shape"), F.col(f"max_{name}").alias("max_shape"))
        for name in arrays
    ]
    return facts.select("num_samples", F.explode(F.array(*rows)).alias("_r")).select("_r.field", "num_samples", "_r.min_shape", "_r.max_shape")
