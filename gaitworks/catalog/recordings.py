"""Recordings as NPZ files, and datasets as Parquet, derived from ``embeddings``.

The embeddings of a label, in order, are cut into recordings of ``ROWS``
samples, and tasks write these as NPZ files into the shared folder. Members
beside state and action have flaws by label, for the checks to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.catalog.registry import as_matrix_rows, as_vector_rows, query, table
from gaitworks.functions import text
from gaitworks.operators import checks, indexing
from gaitworks.plans import rebuild
from gaitworks.session import scratch_path
from gaitworks.sources import datasets, npz, recordings
from gaitworks.spec import RolloutSpec

ROWS = 32
SPEC = RolloutSpec(joint_threshold=0.7, lin_threshold=0.25, ang_threshold=0.25)

RECORDINGS = f"""placed AS (
  SELECT label, embedding AS state, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place
  FROM embeddings),
recordings AS (
  SELECT dense_rank() OVER (ORDER BY label, place // {ROWS}) - 1 AS file_idx, place % {ROWS} AS sample_idx,
         count(*) OVER (PARTITION BY label, place // {ROWS}) AS n, label, state,
         printf('rec_%05d_%07d.npz', label, CAST(place // {ROWS} AS BIGINT)) AS name
  FROM placed),
files AS (
  SELECT file_idx, any_value(name) AS name, any_value(label) AS label, count(*) AS num_samples
  FROM recordings GROUP BY file_idx),
offsets AS (
  SELECT *, CAST(coalesce(sum(num_samples) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS BIGINT) AS file_offset
  FROM files)"""

_written: dict[tuple[str, str], str] = {}
_built: dict[tuple[str, str, str], datasets.Dataset] = {}


def _write_one(folder: str):
    """Writes the rows of one recording, at most ``ROWS`` of them, as an NPZ file."""

    def write(rows):
        import io

        import numpy as np
        import pyarrow as pa

        from gaitworks.sources import storage

        rows = rows.sort_by("sample_idx")
        label, block = rows["label"][0].as_py(), rows["block"][0].as_py()
        n = rows.num_rows
        state = np.array(rows["state"].to_pylist(), np.float32)
        action = np.stack([state[:, step : step + 31] for step in range(20)], axis=1)
        members = {
            "state": state,
            "action": action,
            "traj": state.reshape(n, 8, 8),
            "z_style": state[:, : 2 if label % 3 == 0 else 4],
            "short_action": action[:, : 12 if label % 4 == 0 else 20],
            "lossy": state[: n - 1 if label % 5 == 0 else n],
        }
        if label % 2 == 0:
            members["env"] = state[:, :6]
        buffer = io.BytesIO()
        (np.savez_compressed if label % 3 == 1 else np.savez)(buffer, **members)
        path = f"{folder}/rec_{label:05d}_{block:07d}.npz"
        system, inner = storage.resolve(path)
        with system.open_output_stream(inner) as out:
            out.write(buffer.getvalue())
        return pa.table({"path": [path], "n": pa.array([n], pa.int64())})

    return write


def recordings_folder(spark: SparkSession, folder: str) -> str:
    """The folder of NPZ files made from the tables in ``folder``, written once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _written:
        from gaitworks.sources import storage

        target = scratch_path(spark, "recordings")
        system, inner = storage.resolve(target)
        system.create_dir(inner, recursive=True)
        rows = table(spark, folder, "embeddings").select("label", "vec_id", F.col("embedding").alias("state"))
        placed = indexing.sample_index(rows, ["label"], ["vec_id"])
        blocked = placed.withColumn("block", F.floor(F.col("sample_idx") / ROWS)).drop("vec_id")
        made = blocked.groupBy("label", "block").applyInArrow(_write_one(target), "path string, n long")
        made.agg(F.sum("n")).collect()
        _written[key] = target
    return _written[key]


def listed(spark: SparkSession, folder: str) -> DataFrame:
    return recordings.list_recordings(spark, folder=recordings_folder(spark, folder))


def profiled(spark: SparkSession, folder: str) -> DataFrame:
    return recordings.profile(listed(spark, folder))


def _once(spark: SparkSession, folder: str, kind: str, build) -> datasets.Dataset:
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _built:
        _built[key] = build(scratch_path(spark, kind))
    return _built[key]


def consolidated(spark: SparkSession, folder: str) -> datasets.Dataset:
    return _once(
        spark,
        folder,
        "consolidated",
        lambda path: rebuild.consolidate(listed(spark, folder), path, optional=["action", "env", "z_style"]),
    )


def sharded(spark: SparkSession, folder: str) -> datasets.Dataset:
    return _once(
        spark, folder, "shards", lambda path: rebuild.rebuild_from_recordings(listed(spark, folder), path, SPEC)
    )


def materialized_dataset(spark: SparkSession, folder: str) -> datasets.Dataset:
    source = sharded(spark, folder)
    return _once(spark, folder, "materialized", lambda path: datasets.materialize(spark, source.path, path))


@query("A1_list_rollout_files", f"WITH {RECORDINGS} SELECT file_idx, name FROM files")
def list_rollout_files(spark, folder):
    place = recordings_folder(spark, folder)
    both = recordings.list_recordings(spark, folder=place, pattern=f"{place}/rec_*.npz")
    return both.select("file_idx", "name")


ELEMENTS = f"""WITH {RECORDINGS}
SELECT file_idx, sample_idx, CAST(d AS BIGINT) AS dim, CAST(state[d + 1] AS DOUBLE) AS value
FROM (SELECT *, unnest(range(64)) AS d FROM recordings)"""


@query("A2_read_rollouts", ELEMENTS)
def read_rollouts(spark, folder):
    """In splits of a few rows, so that one file is read by several tasks."""
    return as_vector_rows(recordings.read_recordings(profiled(spark, folder), ["state"], split_bytes=4096), "state")


@query("A2_read_rollouts_source", ELEMENTS + " WHERE file_idx % 3 = 1 AND sample_idx BETWEEN 3 AND 20")
def read_rollouts_source(spark, folder):
    """A scan of the engine's that opens every third file and reads some samples of each."""
    headers = profiled(spark, folder)
    third = [row["file_idx"] for row in headers.where("file_idx % 3 = 1").select("file_idx").collect()]
    return as_vector_rows(npz.open_recordings(headers, ["state"], files=third, samples=(3, 21), split_bytes=4096), "state")


@query(
    "A2_read_actions",
    f"""WITH {RECORDINGS}
SELECT file_idx, sample_idx, CAST(s AS BIGINT) AS step, CAST(d AS BIGINT) AS dim,
       CAST(state[s + d + 1] AS DOUBLE) AS value
FROM (SELECT *, unnest(range(29)) AS d FROM (SELECT *, unnest(range(16)) AS s FROM recordings))""",
)
def read_actions(spark, folder):
    read = recordings.read_recordings(profiled(spark, folder), ["state", "action"], {"action": (16, 29)})
    return as_matrix_rows(read, "action")


@query("A3_read_dataset", ELEMENTS)
def read_dataset(spark, folder):
    path = consolidated(spark, folder).path
    return as_vector_rows(datasets.read_dataset(spark, path).samples, "state")


@query(
    "B1_write_consolidated",
    f"""WITH {RECORDINGS}
SELECT file_idx, sample_idx, CAST(s AS BIGINT) AS step, CAST(d AS BIGINT) AS dim,
       CAST(state[8 * s + d + 1] AS DOUBLE) AS value
FROM (SELECT *, unnest(range(8)) AS d FROM (SELECT *, unnest(range(8)) AS s FROM recordings))""",
)
def write_consolidated(spark, folder):
    return as_matrix_rows(consolidated(spark, folder).samples, "traj")


@query("B1_consolidated_files", f"WITH {RECORDINGS} SELECT file_idx, name, num_samples, file_offset FROM offsets")
def consolidated_files(spark, folder):
    return consolidated(spark, folder).files.select("file_idx", "name", "num_samples", "file_offset")


@query(
    "B2_write_shards",
    f"""WITH {RECORDINGS}, norms AS (
  SELECT file_idx, sample_idx,
    CAST(sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN state[30:58]])) AS FLOAT) AS joint,
    CAST(sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN state[59:61]])) AS FLOAT) AS lin,
    CAST(sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN state[62:64]])) AS FLOAT) AS ang
  FROM recordings)
SELECT file_idx, sample_idx,
       CASE WHEN ang > CAST(0.25 AS FLOAT) OR joint > CAST(0.7 AS FLOAT) OR lin > CAST(0.25 AS FLOAT)
            THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS recovery_flag
FROM norms""",
)
def write_shards(spark, folder):
    samples = sharded(spark, folder).samples
    return samples.select("file_idx", "sample_idx", F.col("recovery_flag").cast("double").alias("recovery_flag"))


@query(
    "B3_union_view",
    f"""WITH {RECORDINGS}, pairs AS (
  SELECT r.file_idx, r.sample_idx, o.file_offset + r.sample_idx AS global_row, s AS step,
         greatest(r.sample_idx - 2 + s, 0) AS at
  FROM (SELECT *, unnest(range(3)) AS s FROM recordings) r JOIN offsets o ON o.file_idx = r.file_idx)
SELECT global_row, CAST(step AS BIGINT) AS step, CAST(d AS BIGINT) AS dim, CAST(state[d + 1] AS DOUBLE) AS value
FROM (SELECT p.global_row, p.step, q.state, unnest(range(64)) AS d
      FROM pairs p JOIN recordings q ON q.file_idx = p.file_idx AND q.sample_idx = p.at)""",
)
def union_view(spark, folder):
    return as_matrix_rows(datasets.union_view(sharded(spark, folder)), "state_hist", ("global_row",))


@query(
    "B3_rows_between",
    f"""WITH {RECORDINGS}
SELECT o.file_offset + r.sample_idx AS global_row, CAST(d AS BIGINT) AS dim, CAST(r.state[d + 1] AS DOUBLE) AS value
FROM (SELECT *, unnest(range(64)) AS d FROM recordings) r JOIN offsets o ON o.file_idx = r.file_idx
WHERE o.file_offset + r.sample_idx BETWEEN 40 AND 139""",
)
def rows_between(spark, folder):
    """A range of rows over all files; the scan skips the files outside it."""
    return as_vector_rows(datasets.rows_between(sharded(spark, folder), 40, 140), "state", ("global_row",))


DELTAS = f"""WITH {RECORDINGS}, pairs AS (
  SELECT file_idx, sample_idx, state AS base, s AS step, least(sample_idx + s + 1, n - 1) AS at
  FROM (SELECT *, unnest(range(16)) AS s FROM recordings))
SELECT file_idx, sample_idx, CAST(step AS BIGINT) AS step, CAST(d AS BIGINT) AS dim,
       CAST(state[d + 1] - base[d + 1] AS DOUBLE) AS value
FROM (SELECT p.file_idx, p.sample_idx, p.step, p.base, q.state, unnest(range(64)) AS d
      FROM pairs p JOIN recordings q ON q.file_idx = p.file_idx AND q.sample_idx = p.at)"""


@query("B2_write_shards_cells", DELTAS)
def write_shards_cells(spark, folder):
    return as_matrix_rows(sharded(spark, folder).samples, "state_delta")


@query("B4_materialize", DELTAS)
def materialize(spark, folder):
    return as_matrix_rows(materialized_dataset(spark, folder).samples, "state_delta")


def _bare(spark: SparkSession, folder: str) -> tuple[datasets.Dataset, str]:
    """A dataset of files and meta alone; its files table records where the shards are."""
    source = sharded(spark, folder)
    target = scratch_path(spark, "bare")
    source.files.write.parquet(f"{target}/{datasets.FILES}")
    source.meta.write.parquet(f"{target}/{datasets.META}")
    return source, target


@query("B4_materialize_recorded", DELTAS)
def materialize_recorded(spark, folder):
    """The shards are not below the dataset, but where its files table says."""
    _, bare = _bare(spark, folder)
    return as_matrix_rows(datasets.materialize(spark, bare, scratch_path(spark, "recorded")).samples, "state_delta")


@query("B4_materialize_shard_dir", DELTAS)
def materialize_shard_dir(spark, folder):
    """The shards are in a folder that is given."""
    source, bare = _bare(spark, folder)
    made = datasets.materialize(
        spark, bare, scratch_path(spark, "given"), shard_dir=f"{source.folder}/{datasets.SAMPLES}", part_rows=50
    )
    return as_matrix_rows(made.samples, "state_delta")


@query(
    "B5_dataset_meta",
    """SELECT key, value FROM (VALUES ('cond_steps', '3'), ('horizon_steps', '16'), ('state_dim', '64'),
  ('cmd_dim', '58'), ('recovery_base_ang_thr', '0.25'), ('recovery_joint_vel_thr', '0.7'),
  ('recovery_base_lin_thr', '0.25'), ('materialized_from_vds', 'True'), ('schema', 'derived_shards')) AS t(key, value)
UNION ALL SELECT 'num_samples', CAST(count(*) AS VARCHAR) FROM embeddings
UNION ALL SELECT 'source_files', CAST(sum(f) AS VARCHAR)
FROM (SELECT CAST(ceil(count(*) / 32.0) AS BIGINT) AS f FROM embeddings GROUP BY label)""",
)
def dataset_meta(spark, folder):
    return materialized_dataset(spark, folder).meta.where(~F.col("key").isin("source_dataset", "source_shard_dir"))


@query("B6_write_mode", f"WITH {RECORDINGS} SELECT file_idx, num_samples AS found, true AS refused FROM files")
def write_mode(spark, folder):
    """A second copy to one place is refused, and with overwrite replaces the first."""
    source = sharded(spark, folder).path
    target = scratch_path(spark, "twice")
    datasets.materialize(spark, source, target)
    try:
        datasets.materialize(spark, source, target)
        refused = False
    except FileExistsError:
        refused = True
    replaced = datasets.materialize(spark, source, target, overwrite=True)
    counts = replaced.samples.groupBy("file_idx").agg(F.count("*").alias("found"))
    return counts.withColumn("refused", F.lit(refused))


@query(
    "B7_compression",
    f"""WITH {RECORDINGS}
SELECT codec, file_idx, sample_idx, CAST(state[1] AS DOUBLE) AS first, CAST(state[64] AS DOUBLE) AS last
FROM recordings, (SELECT unnest(['none', 'lzf', 'gzip']) AS codec)""",
)
def compression(spark, folder):
    """The same samples written with each codec and read back."""
    dataset = consolidated(spark, folder)
    states = dataset.samples.select("file_idx", "sample_idx", "state")
    read = None
    for codec in ("none", "lzf", "gzip"):
        path = scratch_path(spark, codec)
        copy = datasets.write_consolidated(states, dataset.files, path, compression=codec, level=1)
        rows = copy.samples.withColumn("codec", F.lit(codec))
        read = rows if read is None else read.unionByName(rows)
    value = [F.get("state", F.lit(i)).cast("double").alias(name) for i, name in ((0, "first"), (63, "last"))]
    return read.select("codec", "file_idx", "sample_idx", *value)


@query(
    "B7_compression_cells",
    f"""WITH {RECORDINGS}
SELECT codec, file_idx, sample_idx, CAST(d AS BIGINT) AS dim, CAST(state[d + 1] AS DOUBLE) AS value
FROM (SELECT *, unnest(range(64)) AS d FROM recordings), (SELECT unnest(['none', 'lzf', 'gzip']) AS codec)""",
)
def compression_cells(spark, folder):
    dataset = consolidated(spark, folder)
    states = dataset.samples.select("file_idx", "sample_idx", "state")
    read = None
    for codec in ("none", "lzf", "gzip"):
        path = scratch_path(spark, codec)
        copy = datasets.write_consolidated(states, dataset.files, path, compression=codec, level=1)
        rows = copy.samples.withColumn("codec", F.lit(codec))
        read = rows if read is None else read.unionByName(rows)
    return as_vector_rows(read, "state", ("codec", "file_idx", "sample_idx"))


@query(
    "C1_require_fields",
    f"WITH {RECORDINGS} SELECT file_idx, 'env' AS field FROM files WHERE label % 2 = 1",
)
def require_fields(spark, folder):
    return checks.require_fields(profiled(spark, folder), ["state", "action", "env"]).select("file_idx", "field")


@query(
    "C2_check_dims",
    f"""WITH {RECORDINGS}
SELECT file_idx, 'action has fewer steps than the horizon' AS problem FROM files WHERE label % 4 = 0
UNION ALL SELECT file_idx, 'state and action differ in sample count' FROM files WHERE label % 5 = 0
UNION ALL SELECT file_idx, 'no samples' FROM files WHERE label % 5 = 0 AND num_samples = 1""",
)
def check_dims(spark, folder):
    found = checks.check_dims(profiled(spark, folder), SPEC, state="lossy", action="short_action")
    return found.select("file_idx", "problem")


SHAPES = f"""WITH {RECORDINGS}, first_seen AS (SELECT (SELECT label FROM files WHERE file_idx = 0) % 3 = 0 AS narrow)"""


@query(
    "C3_common_fields",
    f"""{SHAPES}
SELECT 'state' AS field, '64' AS shape, CAST(0 AS BIGINT) AS missing_files, CAST(0 AS BIGINT) AS inconsistent_files, true AS kept
UNION ALL SELECT 'traj', '8,8', 0, 0, true
UNION ALL SELECT 'env', '6', CAST(count_if(label % 2 = 1) AS BIGINT), 0, count_if(label % 2 = 1) = 0 FROM files
UNION ALL SELECT 'z_style', any_value(CASE WHEN narrow THEN '2' ELSE '4' END), 0,
  CAST(count_if((label % 3 = 0) <> narrow) AS BIGINT), count_if((label % 3 = 0) <> narrow) = 0 FROM files, first_seen
UNION ALL SELECT 'cmd', NULL, count(*), 0, false FROM files""",
)
def common_fields(spark, folder):
    found = checks.common_fields(profiled(spark, folder), ["state", "traj", "env", "z_style", "cmd"])
    # joined as text; a field that no file has keeps its null
    shape = F.when(F.col("shape").isNotNull(), F.concat_ws(",", F.col("shape").cast("array<string>")))
    return found.withColumn("shape", shape)


def _first_names(condition: str) -> str:
    return (
        f"(SELECT coalesce(string_agg(name, ',' ORDER BY file_idx), '') FROM "
        f"(SELECT * FROM files, first_seen WHERE {condition} ORDER BY file_idx LIMIT 3))"
    )


@query(
    "C4_field_report",
    f"""{SHAPES}
SELECT * FROM (
SELECT 'env' AS field, CAST(count_if(label % 2 = 1) AS BIGINT) AS missing_files, CAST(0 AS BIGINT) AS inconsistent_files,
       {_first_names("label % 2 = 1")} AS missing_examples, '' AS inconsistent_examples FROM files
UNION ALL SELECT 'z_style', 0, CAST(count_if((label % 3 = 0) <> narrow) AS BIGINT), '',
       {_first_names("(label % 3 = 0) <> narrow")} FROM files, first_seen
UNION ALL SELECT 'cmd', count(*), 0, {_first_names("true")}, '' FROM files)
WHERE missing_files + inconsistent_files > 0""",
)
def field_report(spark, folder):
    found = checks.field_report(profiled(spark, folder), ["state", "traj", "env", "z_style", "cmd"])
    names = [F.array_join(name, ",").alias(name) for name in ("missing_examples", "inconsistent_examples")]
    return found.select("field", "missing_files", "inconsistent_files", *names)


@query(
    "C5_check_counts",
    f"""WITH {RECORDINGS}
SELECT file_idx, 'lossy' AS field, num_samples - 1 AS found, num_samples AS expected FROM files WHERE label % 5 = 0""",
)
def check_counts(spark, folder):
    found = checks.check_counts(profiled(spark, folder), ["state", "action", "lossy"])
    return found.select("file_idx", "field", "found", "expected")


@query(
    "C6_reconcile",
    f"""WITH {RECORDINGS}
SELECT r.file_idx, num_samples AS declared, CAST(count_if(NOT (r.file_idx % 3 = 0 AND sample_idx = 1)) AS BIGINT) AS found
FROM recordings r JOIN files f ON f.file_idx = r.file_idx
GROUP BY r.file_idx, num_samples HAVING found <> num_samples""",
)
def reconcile(spark, folder):
    """Rows that a faulty copy lost: the second of every third file."""
    dataset = consolidated(spark, folder)
    kept = dataset.samples.where("not (file_idx % 3 = 0 and sample_idx = 1)")
    return checks.reconcile(kept, dataset.files)


@query(
    "G2_resolve_shards",
    f"WITH {RECORDINGS} SELECT file_idx, 'file_idx=' || file_idx AS shard FROM files",
)
def resolve_shards(spark, folder):
    """The expected folder lacks the shards, so the recorded places are taken."""
    dataset = sharded(spark, folder)
    found = datasets.resolve_shards(dataset.files, f"{dataset.path}/elsewhere")
    return found.select("file_idx", text.path_name(F.col("path")).alias("shard"))


@query(
    "J1_concat_shards",
    f"""WITH {RECORDINGS}, total AS (SELECT count(*) AS f, sum(num_samples) AS n FROM files)
SELECT file_idx, num_samples, file_offset, num_samples AS rows_found FROM offsets
UNION ALL SELECT file_idx + f, num_samples, CAST(file_offset + n AS BIGINT), num_samples FROM offsets, total""",
)
def concat_shards(spark, folder):
    samples, files = datasets.concat_datasets(sharded(spark, folder), materialized_dataset(spark, folder))
    found = samples.groupBy("file_idx").agg(F.count("*").alias("rows_found"))
    return files.join(found, "file_idx").select("file_idx", "num_samples", "file_offset", "rows_found")


@query("J2_distinct_paths", f"WITH {RECORDINGS} SELECT name FROM files")
def distinct_paths(spark, folder):
    rows = consolidated(spark, folder).files
    return rows.select("path").union(listed(spark, folder).select("path")).distinct().select(
        text.path_name(F.col("path")).alias("name")
    )


@query(
    "J3_missing_shards",
    f"WITH {RECORDINGS} SELECT file_idx, 'file_idx=' || file_idx AS shard FROM files WHERE file_idx % 3 = 1",
)
def missing_shards(spark, folder):
    """A third of the shards is expected under a name that is not there."""
    dataset = sharded(spark, folder)
    shown = F.when(F.col("file_idx") % 3 == 1, F.concat(F.lit(f"{dataset.path}/lost/file_idx="), "file_idx"))
    places = dataset.files.select("file_idx", F.coalesce(shown, "shard_path").alias("expected"))
    looked = datasets.present_paths(places, "expected").withColumnRenamed("present", "expected_present")
    return datasets.missing_shards(looked).select("file_idx", text.path_name(F.col("path")).alias("shard"))
