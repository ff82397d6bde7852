"""What several operators share: keys, stored tables, checked joins, slices of Arrow batches, hashes in NumPy."""

from __future__ import annotations

import atexit
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.session import scratch_path, shared_dir, ship_package

#: A side is broadcast only when its stored Parquet files are no larger than this; else both sides are shuffled.
BROADCAST_BYTES = 12 << 20
#: Texts are worked on in slices of about so many bytes, so that NumPy's temporaries stay small.
SLICE_BYTES = 1 << 20

_scratch: list[tuple[SparkSession, str]] = []


def prepared(spark: SparkSession) -> SparkSession:
    """Workers get the package, checkpoints a folder, and Arrow batches a bound that fits long texts."""
    ship_package(spark)
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def _clear() -> None:
    """Drop the stored tables when the driver ends; the cluster's own clean-up of the shared folder does the rest."""
    for spark, path in _scratch:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            return


atexit.register(_clear)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and no lost executor makes it run again."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """The size of the files below a table that ``stored`` returned."""
    spark = df.sparkSession
    total = 0
    for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total += system.getContentSummary(place).getLength()
    return total


def checked(side: DataFrame, bound: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if its files are small enough; Spark shuffles both sides otherwise."""
    return F.broadcast(side) if stored_bytes(side) <= bound else side


def text_keys(text: str | Column) -> tuple[Column, Column]:
    """128 bits that stand for a text; rows with equal texts share every result that depends on the text alone."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.xxhash64(column), F.xxhash64(F.lit(7), column)


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that no column of the input has, whatever its letter case."""
    low = {name.lower() for name in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(column: pa.Array) -> pa.Array:
    return column.fill_null("")


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have ``limit`` bytes at most, or the slice is one row."""
    offsets = string_bytes(batch.column(column))[1]
    at, last = 0, batch.num_rows
    while at < last:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), last)
        yield batch.slice(at, end - at)
        at = end


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the offset of each text and of the end."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


# ---------------------------------------------------------------- hashes: polynomials modulo 2^64, then a mixer

_BASE = np.uint64(0x9E6C63D0676A9A99)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: The same with A to Z as a to z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse."""
    if len(_powers[0]) < count:
        size = max(count, 1 << 16)
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:count], _powers[1][:count]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Not mixed yet: add what else should count, then ``mix``."""
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LONG = 1 << 22


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (maximal run of bytes other than space and 9 to 13), and the words before each text.

    A text beyond 4 MB is worked through in pieces that end at white space.
    """
    if len(data) > _LONG and len(offsets) == 2:
        found, at = [], 0
        while at < len(data):
            end = min(at + _LONG, len(data))
            if end < len(data):
                gaps = np.flatnonzero(SPACE[data[at:end]])
                more = at + int(gaps[-1]) + 1 if len(gaps) else end
                while not len(gaps) and more < len(data) and not SPACE[data[more]]:
                    more += 1
                end = more
            found.append(word_hashes(data[at:end], np.array([0, end - at]), fold)[0])
            at = end
        words = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return words, np.array([0, len(words)])
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = bounds[bounds > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = prefix_sums((FOLDED_VALUES if fold else BYTE_VALUES)[data])
    hashes = mix(span_hashes(sums, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, offsets)


def long_array(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as signed ones of the same bits."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
