"""Row positions: dense numbering, offsets, ranges and look-up by global row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitworks.operators.joins import BROADCAST_BYTES, join_lookup, join_stored
from gaitworks.session import materialized, stored, stored_bytes

BLOCK_ROWS = 1 << 20
OFFSET_BLOCK = 1 << 16


def _as_long(df: DataFrame, name: str) -> Column:
    """An order column as a number that sorts alike."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(name).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.TimestampNTZType):
        # from its fields, as a cast would go through the session's time zone
        minutes = (F.unix_date(F.to_date(name)) * F.lit(24) + F.hour(name)) * F.lit(60) + F.minute(name)
        seconds = F.date_part(F.lit("SECOND"), F.col(name))
        return minutes.cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    raise TypeError(f"order column {name} must be an integer, date or timestamp, not {kind.simpleString()}")


def sample_index(
    df: DataFrame,
    files: Sequence[str],
    order: Sequence[str],
    name: str = "sample_idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Position of each row within its file, from 0, in the given order.

    A file above ``block_rows`` rows is cut along the order columns into value
    ranges, and a range that is still too heavy is cut again, so that no task
    numbers more than ``block_rows`` rows however the rows are spread over
    files (only rows that agree in all order columns stay together). The
    tables of heavy ranges and of range starts have a few entries per
    ``block_rows`` input rows; they are stored, and broadcast if their size allows.
    """
    files, order = list(files), list(order)
    keys = [_as_long(df, column) for column in order]
    rows, blocks, level = df, [], 0
    split_files = None
    while True:
        bounds = [
            bound
            for i, key in enumerate(keys)
            for bound in (F.min(key).alias(f"_lo{i}"), F.max(key).alias(f"_hi{i}"))
        ]
        spread = reduce(lambda a, b: a | b, [F.col(f"_hi{i}") > F.col(f"_lo{i}") for i in range(len(keys))])
        heavy = (
            rows.groupBy(*files, *blocks)
            .agg(F.count("*").alias("_n"), *bounds)
            .where((F.col("_n") > block_rows) & spread)
        )
        heavy = stored(heavy, "heavy-ranges")
        if heavy.isEmpty():
            break
        if split_files is None:
            split_files = _sized(stored(heavy.select(*files).withColumn("_split", F.lit(True)), "split-files"))
        parts = 2.0 * F.col("_n") / block_rows
        cut = None
        for i, key in enumerate(keys):
            low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            width = F.ceil((high - low + 1) / parts)
            position = F.floor((key - low - F.pmod(key - low, width)) / width)
            cut = F.when(high > low, position) if cut is None else cut.when(high > low, position)
        block = f"_block{level}"
        rows = _join_null_safe(rows, _sized(heavy), files + blocks, "left")
        rows = rows.withColumn(block, F.coalesce(cut, F.lit(0).cast("long")))
        rows = rows.select(*df.columns, *blocks, block)
        blocks.append(block)
        level += 1

    within = Window.partitionBy(*files, *blocks).orderBy(*order)
    numbered = rows.withColumn(name, (F.row_number().over(within) - 1).cast("long"))
    if not blocks:
        return numbered
    sizes = _join_null_safe(
        rows.groupBy(*files, *blocks).agg(F.count("*").alias("_n")), split_files, files, "inner"
    )
    earlier = Window.partitionBy(*files).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*files, *blocks, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = _join_null_safe(numbered, _sized(stored(starts, "range-starts")), files + blocks, "left")
    return placed.withColumn(name, F.col(name) + F.coalesce("_start", F.lit(0))).select(*df.columns, name)


def _sized(table: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(table) if stored_bytes(table) <= BROADCAST_BYTES else table


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi join in which null keys match; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({key: f"_r_{key}" for key in keys})
    condition = reduce(
        lambda a, b: a & b, [left[key].eqNullSafe(renamed[f"_r_{key}"]) for key in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])


def global_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense position from 0 over a total order, without a single-task sort.

    Rows are range-partitioned and sorted, and the result is checkpointed, so
    that the partition sizes and the rows come from one and the same split.
    Only one row per partition goes through the running sum.
    """
    marker = "_at"
    ranged = materialized(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(marker, F.monotonically_increasing_id())
    )
    # the id holds the partition in its upper bits and the position in the lower 33
    part = F.shiftright(marker, 33)
    place = F.col(marker).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + place).cast("long"))
        .select(*df.columns, name)
    )


def with_offsets(
    files: DataFrame,
    value: str = "num_samples",
    order: str = "file_idx",
    name: str = "file_offset",
    block: int = OFFSET_BLOCK,
) -> DataFrame:
    """Exclusive running sum over files, in two steps.

    Files are summed in blocks of consecutive indices; the single-task window
    only sees one row per block.
    """
    blocked = files.withColumn("_blk", F.call_function("div", F.col(order), F.lit(block)))
    within = Window.partitionBy("_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("_blk").agg(F.sum(value).alias("_total"))
    starts = totals.select("_blk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inner = F.coalesce(F.sum(value).over(within), F.lit(0))
    return (
        blocked.withColumn("_inner", inner)
        .join(starts, "_blk")
        .withColumn(name, (F.col("_start") + F.col("_inner")).cast("long"))
        .select(*files.columns, name)
    )


def file_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("file_idx").agg(F.count("*").alias("num_samples"))


def total_samples(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("num_samples"), F.lit(0)).cast("long").alias("total_samples"))


def file_ranges(files: DataFrame, total: int, cap: int | None = None) -> DataFrame:
    """``[start, end)`` of each file from the offsets alone, cut at the cap, and its rebased offset.

    ``files`` has ``file_idx``, with or without gaps, and ``file_offset``. With
    a ``num_samples`` column a file ends so many rows after its start; without,
    where the next file in order starts.
    """
    limit = total if cap is None or cap <= 0 else min(cap, total)
    if "num_samples" in files.columns:
        ended = files.withColumn("_next", F.col("file_offset") + F.col("num_samples")).drop("num_samples")
    else:
        ended = _with_next(files, "file_offset")
    ranges = (
        ended.withColumnRenamed("file_offset", "start")
        .withColumn("end", F.least(F.coalesce("_next", F.lit(total)), F.lit(limit)).cast("long"))
        .drop("_next")
        .where(F.col("end") > F.col("start"))
        .withColumn("num_samples", F.col("end") - F.col("start"))
    )
    return with_offsets(ranges, name="out_offset")


def _with_next(files: DataFrame, value: str, order: str = "file_idx", block: int = OFFSET_BLOCK) -> DataFrame:
    """Adds ``_next``, the value of the next file in order, null for the last one.

    Looked for within blocks of indices first; the single-task window only sees
    one row per block.
    """
    blocked = files.withColumn("_blk", F.call_function("div", F.col(order), F.lit(block)))
    firsts = blocked.groupBy("_blk").agg(F.min_by(value, order).alias("_first"))
    after = firsts.select("_blk", F.lead("_first").over(Window.orderBy("_blk")).alias("_after"))
    inner = F.lead(value).over(Window.partitionBy("_blk").orderBy(order))
    return blocked.withColumn("_in", inner).join(after, "_blk").select(*files.columns, F.coalesce("_in", "_after").alias("_next"))


def cap_files(files: DataFrame, max_files: int | None) -> DataFrame:
    """The first files in path order; none or a number below 1 keeps all."""
    if max_files is None or max_files <= 0:
        return files
    return files.where(F.col("file_idx") < max_files)


def attach_offset(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``global_row``, the position over all files."""
    places = files.select("file_idx", "file_offset")
    return (
        join_lookup(samples, places, ["file_idx"], F.col("sample_idx"))
        .withColumn("global_row", F.col("file_offset") + F.col("sample_idx"))
        .drop("file_offset")
    )


def cap_samples(samples: DataFrame, files: DataFrame, max_samples: int | None) -> DataFrame:
    """The first rows over all files; to be applied before windows, since it moves the end of a file.

    Offsets grow with the file index, so the files in reach are known by their
    last index; that plain filter reaches the scan, which skips the rest.
    """
    if max_samples is None or max_samples <= 0:
        return samples
    kept = files.where(F.col("file_offset") < max_samples).select(
        "file_idx", (F.lit(max_samples) - F.col("file_offset")).alias("_rows")
    )
    kept = stored(kept, "files-in-reach")
    last = kept.agg(F.coalesce(F.max("file_idx"), F.lit(-1))).first()[0]
    near = samples.where((F.col("file_idx") <= last) & (F.col("sample_idx") < max_samples))
    joined = join_stored(near, kept, ["file_idx"], F.col("sample_idx"))
    return joined.where(F.col("sample_idx") < F.col("_rows")).drop("_rows")


def _bucket(place: Column, bucket: int) -> Column:
    return F.call_function("div", place.cast("long"), F.lit(bucket).cast("long"))


def locate_samples(
    rows: DataFrame, files: DataFrame, row: str = "global_row", bucket: int | None = None
) -> DataFrame:
    """File and position of each global row: an interval look-up as an equi join.

    Each file is listed once per bucket of global rows it touches. With the
    mean file length as bucket that makes at most two entries per file on
    average; and as every entry covers at least one row, a bucket never has
    more entries than rows.
    """
    filled = stored(files.where(F.col("num_samples") > 0).select("file_idx", "file_offset", "num_samples"), "filled-files")
    if bucket is None:
        bucket = filled.agg(F.coalesce(F.ceil(F.avg("num_samples")), F.lit(1))).first()[0]
    spans = filled.select(
        "file_idx", "file_offset", (F.col("file_offset") + F.col("num_samples")).alias("_end")
    ).withColumn(
        "_bucket",
        F.explode(F.sequence(_bucket(F.col("file_offset"), bucket), _bucket(F.col("_end") - 1, bucket))),
    )
    inside = (F.col(row) >= F.col("file_offset")) & (F.col(row) < F.col("_end"))
    looked_up = rows.withColumn("_bucket", _bucket(F.col(row), bucket))
    return (
        join_lookup(looked_up, spans, ["_bucket"], F.struct(*rows.columns))
        .where(inside)
        .withColumn("sample_idx", F.col(row) - F.col("file_offset"))
        .select(*rows.columns, "file_idx", "sample_idx")
    )
