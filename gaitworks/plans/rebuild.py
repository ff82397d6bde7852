"""Jobs that build datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.operators import checks
from gaitworks.operators.features import BLOCK_ROWS, FEATURES, derive, needs_window, window_partitions
from gaitworks.operators.indexing import cap_samples, file_ranges, with_offsets
from gaitworks.sources import datasets, recordings
from gaitworks.spec import RolloutSpec

# The optional fields a consolidated dataset looks for.
OPTIONAL_FIELDS = ("action", "cmd", "env", "z_style", "state_hist", "cmd_hist", "state_delta", "recovery_flag")


def consolidate(
    files: DataFrame,
    path: str,
    traj: str = "traj",
    state: str = "state",
    optional: Sequence[str] = OPTIONAL_FIELDS,
    require_optional: bool = False,
    compression: str = "none",
    level: int | None = 4,
) -> datasets.Dataset:
    """All recordings in one dataset, with the optional fields that all of them share.

    Headers are read once; every check and the schema come
    from them. Then each array is read once and written as read, without a
    shuffle of the samples.
    """
    required = [traj, state]
    profiled = recordings.profile(files)
    checks.raise_if_any(checks.require_fields(profiled, required), "missing fields", ["file_idx", "field"])
    judged = {row["field"]: row for row in checks.common_fields(profiled, [*required, *optional]).collect()}
    for name in required:
        if not judged[name]["kept"]:
            raise ValueError(f"field {name!r} differs in shape in {judged[name]['inconsistent_files']} files")
    if require_optional:
        report = checks.field_report(profiled, optional)
        checks.raise_if_any(report, "required fields are not in all files with one shape", ["field"])
    kept = [name for name in optional if judged[name]["kept"]]
    fields = [*required, *kept]
    checks.raise_if_any(checks.check_counts(profiled, fields), "sample counts differ", ["file_idx", "field"])

    samples = recordings.read_recordings(profiled, fields)
    counted = recordings.files_table(profiled, traj)
    meta = {f"{name}_shape": str(tuple(judged[name]["shape"])) for name in required}
    return datasets.write_consolidated(
        samples, counted, path, meta, compression=compression, level=level, in_order=True
    )


def _partitions(files: DataFrame, spec: RolloutSpec, block_rows: int) -> int:
    rows = files.agg(F.coalesce(F.sum("num_samples"), F.lit(0))).first()[0]
    return window_partitions(rows, spec, files.sparkSession.sparkContext.defaultParallelism, block_rows)


def rebuild_from_recordings(
    files: DataFrame,
    path: str,
    spec: RolloutSpec = RolloutSpec(),
    state: str = "state",
    action: str = "action",
    features: Sequence[str] = FEATURES,
    overwrite: bool = True,
    compression: str = "gzip",
    level: int | None = 1,
    block_rows: int = BLOCK_ROWS,
) -> datasets.Dataset:
    """Recordings to a derived dataset, one shard folder per recording.

    Fields are trimmed in the decoder. The one shuffle deals blocks to
    partitions by their place over all files, so a task holds neighbouring
    blocks, and a shard folder has one part per task that holds some of its rows.
    """
    profiled = recordings.profile(files)
    checks.raise_if_any(checks.require_fields(profiled, [state, action]), "missing fields", ["file_idx", "field"])
    checks.raise_if_any(checks.check_dims(profiled, spec, state, action), "unusable recordings", ["file_idx", "problem"])
    trim = {state: (spec.state_dim,), action: (spec.horizon_steps, spec.action_dim)}
    samples = recordings.read_recordings(profiled, [state, action], trim)
    samples = samples.withColumnsRenamed({state: "state", action: "action"})
    counted = with_offsets(recordings.files_table(profiled, state))
    partitions = _partitions(counted, spec, block_rows)
    derived = derive(samples, spec, features, block_rows, offsets=counted, partitions=partitions, trimmed_action=True)
    meta = {"schema": "derived_shards", **spec.meta()}
    # rows without a window come as read, which is in runs of files just as well
    return datasets.write_shards(derived, counted, path, meta, overwrite, compression, level, part_rows=None)


def rebuild_from_dataset(
    spark: SparkSession,
    source: str,
    path: str,
    spec: RolloutSpec = RolloutSpec(),
    max_samples: int | None = None,
    features: Sequence[str] = FEATURES,
    compression: str = "gzip",
    level: int | None = 1,
    block_rows: int = BLOCK_ROWS,
) -> datasets.Dataset:
    """A consolidated dataset to a derived one; the cap counts rows over all files and comes first.

    The one shuffle of the samples deals blocks to partitions by their place
    over all files, so that the derived rows, several times as wide, are
    written in order without another.
    """
    read = datasets.read_dataset(spark, source)
    total = read.files.agg(F.coalesce(F.sum("num_samples"), F.lit(0))).first()[0]
    kept = file_ranges(read.files, total, max_samples)
    if kept.isEmpty():
        raise ValueError("no samples are left after the cap")
    samples = cap_samples(read.samples.select("file_idx", "sample_idx", "state", "action"), read.files, max_samples)
    files = kept.select(
        "file_idx", *[name for name in ("name", "path") if name in read.files.columns], "num_samples",
        F.col("out_offset").alias("file_offset"),
    )
    partitions = _partitions(files, spec, block_rows)
    derived = derive(samples, spec, features, block_rows, offsets=files, partitions=partitions)
    meta = {"schema": "derived_dataset", "source_samples": total, "source_dataset": source, **spec.meta()}
    # without a window nothing puts the rows in order on the way
    return datasets.write_consolidated(
        derived, files, path, meta, compression=compression, level=level, in_order=needs_window(features)
    )
