"""NPZ files written by the test, read back, checked, rebuilt and compared with NumPy."""

import io
import os
import re
import shutil
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitworks.operators import checks
from gaitworks.operators.features import window_partitions
from gaitworks.plans import rebuild
from gaitworks.sources import datasets, npz, recordings, storage
from gaitworks.spec import RolloutSpec


def recording(rng, n, width=64, steps=20, dims=31, traj=(5, 3)):
    return {
        "state": rng.normal(size=(n, width)).astype(np.float64),
        "action": rng.normal(size=(n, steps, dims)).astype(np.float32),
        "traj": rng.normal(size=(n, *traj)).astype(np.float32),
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(7)
    root = tmp_path_factory.mktemp("npz")
    for name, n in (("a", 5), ("b", 7), ("c", 3)):
        np.savez(root / f"{name}.npz", **recording(rng, n))
    np.savez_compressed(root / "d.npz", **recording(rng, 40))
    one = recording(rng, 1)
    one["state"] = np.asfortranarray(one["state"])
    np.savez(root / "e.npz", **one)
    wide = recording(rng, 6)
    wide["state"] = np.asfortranarray(wide["state"])
    np.savez(root / "f.npz", **wide)
    (root / "notes.txt").write_text("no recording")
    (root / "below").mkdir()
    np.savez(root / "below" / "z.npz", **recording(rng, 2))
    return root


def expected(path, spec):
    with np.load(path) as data:
        state = data["state"].astype(np.float32)
        action = data["action"].astype(np.float32)[:, : spec.horizon_steps, : spec.action_dim]
    n = len(state)
    full, state = state, state[:, : spec.state_dim]
    rows = []
    for t in range(n):
        past = [max(t - k, 0) for k in reversed(range(spec.cond_steps))]
        ahead = [min(t + k, n - 1) for k in range(1, spec.horizon_steps + 1)]
        norms = [np.sqrt((state[t, a:b].astype(np.float64) ** 2).sum()) for a, b in ((29, 58), (58, 61), (61, 64))]
        flag = float(norms[2] > spec.ang_threshold or norms[0] > spec.joint_threshold or norms[1] > spec.lin_threshold)
        rows.append(
            {
                "action": action[t],
                "state": state[t],
                "cmd": state[t, : spec.cmd_dim],
                "state_hist": state[past],
                "cmd_hist": full[past][:, : spec.cmd_dim],
                "state_delta": state[ahead] - state[t],
                "recovery_flag": np.float32(flag),
            }
        )
    return rows


def assert_derived(samples, names, root, spec, limits=None):
    rows = {}
    for row in samples.collect():
        rows.setdefault(row["file_idx"], {})[row["sample_idx"]] = row
    for file_idx, name in enumerate(names):
        want = expected(root / name, spec)
        assert sorted(rows[file_idx]) == list(range(len(want)))
        for t, fields in enumerate(want):
            for field, value in fields.items():
                np.testing.assert_array_equal(np.array(rows[file_idx][t][field], np.float32), value, err_msg=field)


NAMES = ["a.npz", "b.npz", "c.npz", "d.npz", "e.npz", "f.npz"]


def test_listing(spark, folder, monkeypatch):
    listed = recordings.list_recordings(spark, folder=str(folder)).orderBy("file_idx").collect()
    assert [row["name"] for row in listed] == NAMES
    assert [row["file_idx"] for row in listed] == list(range(6))
    assert listed[0]["path"] == str(folder / "a.npz")
    both = recordings.list_recordings(
        spark, folder=str(folder), pattern=f"{folder}/[ab].npz", files=[f"{folder}/below/../a.npz", f"file:{folder}/c.npz"]
    )
    assert both.count() == 6
    deep = recordings.list_recordings(spark, pattern=f"{folder}/*/*.npz")
    assert [row["name"] for row in deep.collect()] == ["z.npz"]
    assert recordings.list_recordings(spark, folder=str(folder), max_files=2).count() == 2
    assert recordings.list_recordings(spark, folder=str(folder), max_files=0).count() == 6
    with pytest.raises(FileNotFoundError):
        recordings.list_recordings(spark, folder=str(folder / "nowhere"))
    monkeypatch.chdir(folder.parent)
    relative = recordings.list_recordings(spark, pattern=f"{folder.name}/a*.npz", files=[f"{folder.name}/a.npz"])
    assert [row["path"] for row in relative.collect()] == [str(folder / "a.npz")]


@pytest.mark.parametrize("split_bytes", [128 << 20, 1 << 15, 1])
def test_read_in_splits(spark, folder, split_bytes):
    profiled = recordings.profile(recordings.list_recordings(spark, folder=str(folder)))
    read = recordings.read_recordings(profiled, ["state", "traj", "action"], {"action": (16, 29)}, split_bytes)
    rows = {(row["file_idx"], row["sample_idx"]): row for row in read.collect()}
    seen = 0
    for file_idx, name in enumerate(NAMES):
        with np.load(folder / name) as data:
            for t in range(len(data["state"])):
                row = rows[file_idx, t]
                np.testing.assert_array_equal(np.array(row["state"], np.float32), data["state"][t].astype(np.float32))
                np.testing.assert_array_equal(np.array(row["traj"], np.float32), data["traj"][t])
                np.testing.assert_array_equal(np.array(row["action"], np.float32), data["action"][t, :16, :29])
                seen += 1
    assert seen == len(rows)
    placed = read.select("file_idx", "sample_idx", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    ordered = [(row["file_idx"], row["sample_idx"]) for row in placed.orderBy("m").collect()]
    assert ordered == sorted(ordered)
    if split_bytes == 1:
        assert placed.select("p").distinct().count() > 8


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_rebuild_from_recordings(spark, folder, tmp_path, block_rows):
    spec = RolloutSpec(joint_threshold=5.5, lin_threshold=2.5, ang_threshold=2.5)
    files = recordings.list_recordings(spark, folder=str(folder))
    built = rebuild.rebuild_from_recordings(files, str(tmp_path / "out"), spec, block_rows=block_rows)
    assert_derived(built.samples, NAMES, folder, spec)
    # a task holds neighbouring blocks: a part for each task and file it holds, not for each block
    tasks = window_partitions(62, spec, spark.sparkContext.defaultParallelism, block_rows)
    assert len(list((tmp_path / "out" / "samples").rglob("*.parquet"))) <= tasks + len(NAMES) - 1
    flags = {row[0] for row in built.samples.select("recovery_flag").distinct().collect()}
    assert flags == {0.0, 1.0}
    offsets = [row["file_offset"] for row in built.files.orderBy("file_idx").collect()]
    assert offsets == [0, 5, 12, 15, 55, 56]
    meta = built.meta_dict()
    assert meta["num_samples"] == "62" and meta["cond_steps"] == "3" and meta["recovery_base_ang_thr"] == "2.5"
    globals_ = [row[0] for row in datasets.union_view(built).select("global_row").orderBy("global_row").collect()]
    assert globals_ == list(range(62))

    whole = datasets.materialize(spark, str(tmp_path / "out"), str(tmp_path / "one"))
    assert_derived(whole.samples, NAMES, folder, spec)
    assert whole.meta_dict()["materialized_from_vds"] == "True"
    with pytest.raises(FileExistsError):
        datasets.materialize(spark, str(tmp_path / "out"), str(tmp_path / "one"))
    datasets.materialize(spark, str(tmp_path / "out"), str(tmp_path / "one"), overwrite=True)


def test_shards_are_read_where_they_are(spark, folder, tmp_path):
    spec = RolloutSpec(joint_threshold=5.5)
    files = recordings.list_recordings(spark, folder=str(folder))
    built = rebuild.rebuild_from_recordings(files, str(tmp_path / "out"), spec)
    # a dataset of files and meta alone, whose files table still tells where the shards are
    bare = tmp_path / "bare"
    built.files.write.parquet(str(bare / "files"))
    built.meta.write.parquet(str(bare / "dataset_meta"))
    copied = datasets.materialize(spark, str(bare), str(tmp_path / "one"), part_rows=20)
    assert len(copied.samples.inputFiles()) <= max(4, spark.sparkContext.defaultParallelism)
    assert_derived(copied.samples, NAMES, folder, spec)
    assert copied.meta_dict()["source_shard_dir"] == f"{bare}/samples"
    # shards elsewhere, and no record of them
    moved = tmp_path / "elsewhere"
    (Path(built.folder) / "samples").rename(moved)
    with pytest.raises(FileNotFoundError, match="missing examples: .*file_idx=0.*file_idx=1.*file_idx=2"):
        datasets.materialize(spark, str(bare), str(tmp_path / "two"))
    again = datasets.materialize(spark, str(bare), str(tmp_path / "two"), shard_dir=str(moved))
    assert_derived(again.samples, NAMES, folder, spec)
    assert again.meta_dict()["source_shard_dir"] == str(moved)
    found = datasets.scan_shards(datasets.resolve_shards(built.files, str(moved)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Python" not in plan and "InArrow" not in plan
    assert "hashpartitioning" not in plan.split("FileScan parquet")[0]
    assert sorted((row["file_idx"], row["sample_idx"]) for row in found.select("file_idx", "sample_idx").collect()) == sorted(
        (i, t) for i, n in enumerate([5, 7, 3, 40, 1, 6]) for t in range(n)
    )


def test_shards_under_other_names(spark, tmp_path):
    """Shard folders named after their files, with characters that URIs spell otherwise, and one that is nobody's."""
    samples, files = simple_dataset(spark, [4, 2, 3])
    files = files.withColumn("name", F.concat(F.lit("a b+c%20"), "file_idx", F.lit(".npz")))
    made = datasets.write_shards(samples, files, str(tmp_path / "d"))
    odd = tmp_path / "odd"
    odd.mkdir()
    for i in range(3):
        shutil.copytree(Path(made.folder) / "samples" / f"file_idx={i}", odd / f"a b+c%20{i}.shard")
    shutil.copytree(Path(made.folder) / "samples" / "file_idx=0", odd / "other.shard")
    found = datasets.scan_shards(datasets.resolve_shards(made.files, str(odd), ".shard"))
    assert sorted(tuple(r) for r in found.select("file_idx", "sample_idx", "value").collect()) == sorted(tuple(r) for r in samples.collect())
    # of a folder with more shards than the dataset has, only its own
    few = datasets.scan_shards(datasets.resolve_shards(made.files.where("file_idx <> 1"), f"{made.folder}/samples"))
    assert sorted(r["file_idx"] for r in few.collect()) == [0] * 4 + [2] * 3


def test_presence_is_a_listing_of_folders(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    for name in ("a/x", "a/y z", "top"):
        (tmp_path / name).write_text("")
    cases = {"a/x": True, "a/x/": True, "a/y z": True, "a": True, "a/": True, "top": True, "a/no": False, "none/x": False, "a/x/below": False, "": True}
    paths = [(f"{tmp_path}/{name}" if name else "/tmp",) for name in cases] + [(None,), ("bare",), (f"file:{tmp_path}/top",)]
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(paths)], "present_ int, path string")
    found = [row["present"] for row in datasets.present_paths(table).orderBy("present_").collect()]
    assert found == [*cases.values(), False, False, True]


def _tasks_of(spark, work):
    """The number of tasks of each stage that some work runs."""
    context, group = spark.sparkContext, f"tasks-{uuid.uuid4().hex}"
    context.setJobGroup(group, "counted")
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(stage) for job in jobs for stage in job.stageIds]
    return [stage.numTasks for stage in stages if stage]


def test_many_small_shards_take_few_tasks(spark, tmp_path):
    shards, few = 150, spark.sparkContext.defaultParallelism * 4
    samples = spark.range(shards).select(F.col("id").alias("file_idx"), F.lit(0).cast("long").alias("sample_idx"), F.array(F.col("id").cast("float")).alias("state"))
    files = spark.range(shards).select(F.col("id").alias("file_idx"), F.concat(F.lit("f"), "id").alias("name"), F.lit(1).cast("long").alias("num_samples"))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    before, found = spark.conf.get(key), []

    def work():
        path = str(tmp_path / "shards")
        found.append(datasets.write_shards(samples, files, path).samples)
        found.append(datasets.read_dataset(spark, path, ("state",)).samples)
        found.append(datasets.materialize(spark, path, str(tmp_path / "compact")).samples)
        for rows in found:
            assert sorted((r["file_idx"], r["sample_idx"], r["state"][0]) for r in rows.collect()) == [(i, 0, float(i)) for i in range(shards)]

    try:
        # a partition of the scan for each shard
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        tasks = _tasks_of(spark, work)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert max(tasks) <= few
    assert spark.conf.get(key) == before


def test_a_flat_folder_is_listed_in_batches(spark, tmp_path):
    for number in range(2500):
        (tmp_path / f"rec_{number:05d}.npz").touch()
    assert [len(names) for names in storage.names_below(str(tmp_path), 1000)] == [1000, 1000, 500]
    assert recordings.list_recordings(spark, folder=str(tmp_path)).count() == 2500


def simple_dataset(spark, lengths):
    files = spark.createDataFrame([(i, f"f{i}", n) for i, n in enumerate(lengths)], "file_idx long, name string, num_samples long")
    rows = [(i, t, 100.0 * i + t) for i, n in enumerate(lengths) for t in range(n)]
    return spark.createDataFrame(rows, "file_idx long, sample_idx long, value double"), files


def values(dataset):
    return sorted(row["value"] for row in dataset.samples.collect())


@pytest.mark.parametrize("write", [datasets.write_consolidated, datasets.write_shards])
def test_a_failed_overwrite_leaves_the_old_dataset(spark, tmp_path, write):
    path = str(tmp_path / "d")
    samples, files = simple_dataset(spark, [3])
    with pytest.raises(ValueError):
        write(samples.where("sample_idx < 2"), files, path)
    with pytest.raises(FileNotFoundError, match="no whole dataset"):
        datasets.read_dataset(spark, path, required=())
    write(samples, files, path)
    before = datasets.read_dataset(spark, path, required=())
    # rows that do not add up, and a task that fails while it writes
    with pytest.raises(ValueError):
        write(samples.where("sample_idx < 2"), files, path)
    broken = samples.withColumn("value", F.when(F.col("sample_idx") == 2, F.raise_error("no such sample").cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="no such sample"):
        write(broken, files, path)
    after = datasets.read_dataset(spark, path, required=())
    assert after.folder == before.folder and values(after) == values(before) == [0.0, 1.0, 2.0]
    write(samples.withColumn("value", F.col("value") + 7), files, path)
    assert values(datasets.read_dataset(spark, path, required=())) == [7.0, 8.0, 9.0]
    # who had opened the version before still reads it; the failed ones are gone
    assert values(before) == [0.0, 1.0, 2.0]
    assert [whole for _, _, whole in datasets.versions(path)] == [True, True]
    write(samples, files, path)
    assert len(datasets.versions(path)) == 2
    with pytest.raises(FileExistsError):
        write(samples, files, path, overwrite=False)


def test_datasets_without_versions_are_read_and_replaced(spark, tmp_path):
    samples, files = simple_dataset(spark, [2, 3])
    made = datasets.write_consolidated(samples, files, str(tmp_path / "new"))
    plain = tmp_path / "plain"
    shutil.copytree(made.folder, plain)
    assert datasets.current(str(plain)) == str(plain)
    assert values(datasets.read_dataset(spark, str(plain), required=())) == values(made)
    for extra in (1, 2):
        datasets.write_consolidated(samples.withColumn("value", F.col("value") + extra), files, str(plain))
        assert values(datasets.read_dataset(spark, str(plain), required=()))[0] == extra
    assert sorted(x.name[:7] for x in plain.iterdir()) == ["v000001", "v000002"]


@pytest.mark.parametrize("write,part_rows", [(datasets.write_consolidated, 7), (datasets.write_shards, 7)])
def test_rows_between_read_what_they_must(spark, tmp_path, write, part_rows):
    lengths = [5, 0, 30, 1, 0, 12, 2]
    samples, files = simple_dataset(spark, lengths)
    dataset = write(samples, files, str(tmp_path / "d"), part_rows=part_rows)
    whole = [row["value"] for row in datasets.union_view(dataset).orderBy("global_row").collect()]
    assert len(whole) == 50
    for start, end in [(0, 50), (0, 1), (4, 6), (5, 35), (6, 34), (10, 20), (35, 36), (36, 48), (49, 50), (50, 60), (-5, 3), (20, 20), (30, 10), (47, 99)]:
        found = datasets.rows_between(dataset, start, end).orderBy("global_row").collect()
        assert [row["global_row"] for row in found] == list(range(max(start, 0), min(end, 50))), (start, end)
        assert [row["value"] for row in found] == whole[max(start, 0) : max(end, 0)] if start < end else not found
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = datasets.rows_between(dataset, 10, 20)._jdf.queryExecution().executedPlan().toString()
    across = datasets.rows_between(dataset, 3, 40)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    if write is datasets.write_shards:
        assert re.search(r"PartitionFilters: \[[^\]]*file_idx[^\]]* = 2", plan)
    else:
        assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(file_idx,2\)", plan)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(sample_idx,5\)[^\]]*LessThan\(sample_idx,15\)", plan)
    assert re.search(r"(LessThanOrEqual\(file_idx,5\)|file_idx[^\]]* <= 5)", across)


class CountingFile(io.FileIO):
    total = 0

    def read(self, size=-1):
        data = super().read(size)
        CountingFile.total += len(data)
        return data

    def size(self):
        return os.path.getsize(self.name)


def test_the_source_reads_what_is_asked_for(spark, folder, tmp_path, monkeypatch):
    """Bytes read for the state alone, of some files, of a few samples."""
    profiled = recordings.profile(recordings.list_recordings(spark, folder=str(folder)))
    place = str(tmp_path / "splits")
    monkeypatch.setattr(npz, "scratch_path", lambda spark, label: place)
    npz.open_recordings(profiled, ["state"], split_bytes=1 << 12)

    class System:
        @staticmethod
        def open_input_file(path):
            return CountingFile(path)

    def cost(fields, **wanted):
        reader = npz.Reader(["file_idx", "sample_idx", *fields], place, {}, **wanted)
        partitions = reader.partitions()
        CountingFile.total = 0
        with monkeypatch.context() as patched:
            patched.setattr(storage, "resolve", lambda path: (System, path))
            rows = [(f, s) for p in partitions for batch in reader.read(p) for f, s in zip(batch[0].to_pylist(), batch[1].to_pylist())]
        return CountingFile.total, rows

    both, rows = cost(["state", "action"])
    state, same = cost(["state"])
    assert rows == same == sorted(rows) and len(rows) == 62 and state < both / 2
    one, found = cost(["state"], files=[2])
    assert found == [r for r in rows if r[0] == 2] and one < state / 2
    few, found = cost(["state"], files=[0, 2], samples=[1, 3])
    assert found == [r for r in rows if r[0] in (0, 2) and 1 <= r[1] < 3]
    assert cost(["state"], files=[]) == (0, [])


def test_the_source_equals_the_reader(spark, folder):
    profiled = recordings.profile(recordings.list_recordings(spark, folder=str(folder)))
    fields, trim = ["state", "action"], {"action": (16, 29)}
    reader = recordings.read_recordings(profiled, fields, trim, 1 << 15)
    for files, samples in [(None, None), ([2], None), ([1, 4], (0, 2)), (None, (3, 10**9)), ([99], None), ([], None)]:
        source = npz.open_recordings(profiled, fields, trim, files, samples, 1 << 15)
        wanted = reader.where(f"file_idx IN ({', '.join(map(str, files)) or 'NULL'})") if files is not None else reader
        wanted = wanted.where(F.col("sample_idx").between(samples[0], samples[1] - 1)) if samples else wanted
        assert sorted(map(str, source.collect())) == sorted(map(str, wanted.collect())), (files, samples)
        ordered = [(r["file_idx"], r["sample_idx"]) for r in source.select("file_idx", "sample_idx", F.monotonically_increasing_id().alias("m")).orderBy("m").collect()]
        assert ordered == sorted(ordered)
    # one source, read with several filters in one query and after each other
    source = npz.open_recordings(profiled, ["state"])
    halves = source.where("file_idx <= 1").select("file_idx").unionByName(source.where("file_idx > 1").select("file_idx"))
    assert halves.count() == source.count() == 62 and source.where("sample_idx < 1 OR file_idx = 0").count() == 10
    with pytest.raises(Exception, match="file_idx and sample_idx"):
        spark.read.format(npz.NAME).schema("state array<float>").option("splits", "x").load().collect()


def test_rebuild_of_a_rebuild_with_an_empty_recording(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "npz").mkdir()
    for name, n in (("a", 5), ("b", 0), ("c", 4), ("d", 3)):
        np.savez(tmp_path / "npz" / f"{name}.npz", **recording(rng, n))
    rebuild.consolidate(recordings.list_recordings(spark, folder=str(tmp_path / "npz")), str(tmp_path / "all"), optional=["action"])
    rebuild.rebuild_from_dataset(spark, str(tmp_path / "all"), str(tmp_path / "one"))
    again = rebuild.rebuild_from_dataset(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    rows = [(row["file_idx"], row["file_offset"], row["num_samples"]) for row in again.files.orderBy("file_idx").collect()]
    assert rows == [(0, 0, 5), (2, 5, 4), (3, 9, 3)]
    assert again.samples.count() == 12


def test_narrow_state_and_other_windows(spark, folder, tmp_path):
    spec = RolloutSpec(cond_steps=1, horizon_steps=2, state_dim=60, cmd_dim=10, joint_threshold=5.0, lin_threshold=1.0)
    files = recordings.list_recordings(spark, folder=str(folder))
    built = rebuild.rebuild_from_recordings(files, str(tmp_path / "out"), spec)
    assert_derived(built.samples, NAMES, folder, spec)


def test_consolidate_then_rebuild(spark, folder, tmp_path):
    files = recordings.list_recordings(spark, folder=str(folder))
    one = rebuild.consolidate(files, str(tmp_path / "all"), optional=["action", "env"])
    assert sorted(one.samples.columns) == ["action", "file_idx", "sample_idx", "state", "traj"]
    assert one.meta_dict()["traj_shape"] == "(5, 3)"
    spec = RolloutSpec(joint_threshold=5.5, lin_threshold=2.5, ang_threshold=2.5)
    derived = rebuild.rebuild_from_dataset(spark, str(tmp_path / "all"), str(tmp_path / "derived"), spec)
    assert_derived(derived.samples, NAMES, folder, spec)

    capped = rebuild.rebuild_from_dataset(spark, str(tmp_path / "all"), str(tmp_path / "capped"), spec, max_samples=8)
    rows = capped.samples.orderBy("file_idx", "sample_idx").collect()
    assert [(r["file_idx"], r["sample_idx"]) for r in rows] == [(0, t) for t in range(5)] + [(1, t) for t in range(3)]
    assert not np.any(np.array(rows[-1]["state_delta"]))
    assert [r["file_offset"] for r in capped.files.orderBy("file_idx").collect()] == [0, 5]
    with pytest.raises(ValueError, match="not in all files"):
        rebuild.consolidate(files, str(tmp_path / "x"), optional=["action", "env"], require_optional=True)


@pytest.fixture()
def flawed(tmp_path):
    rng = np.random.default_rng(1)
    good = recording(rng, 4)
    cases = {
        "1_good": good,
        "2_noaction": {key: good[key] for key in ("state", "traj")},
        "3_rank": {**good, "state": good["state"][:, 0]},
        "4_narrow": {**good, "action": good["action"][:, :, :28]},
        "5_counts": {**good, "action": good["action"][:3]},
        "6_empty": {key: value[:0] for key, value in good.items()},
        "7_short": {**good, "action": good["action"][:, :15]},
        "8_state": {**good, "state": good["state"][:, :50]},
    }
    for name, arrays in cases.items():
        np.savez(tmp_path / f"{name}.npz", **arrays)
    return tmp_path


def test_checks(spark, flawed):
    profiled = recordings.profile(recordings.list_recordings(spark, folder=str(flawed)))
    lacking = checks.require_fields(profiled, ["state", "action"]).collect()
    assert [(row["file_idx"], row["field"]) for row in lacking] == [(1, "action")]
    found = {}
    for row in checks.check_dims(profiled).collect():
        found.setdefault(row["file_idx"], set()).add(row["problem"])
    assert found == {
        2: {"state rank is not 2"},
        3: {"action is narrower than action_dim"},
        4: {"state and action differ in sample count"},
        5: {"no samples"},
        6: {"action has fewer steps than the horizon"},
        7: {"state is narrower than state_dim", "state is narrower than cmd_dim"},
    }
    assert 5 not in {row["file_idx"] for row in checks.check_dims(profiled, allow_empty=True).collect()}
    counts = checks.check_counts(profiled, ["state", "action", "traj"]).collect()
    assert [(row["file_idx"], row["field"], row["found"], row["expected"]) for row in counts] == [(4, "action", 3, 4)]
    with pytest.raises(ValueError, match="unusable.*3_rank"):
        checks.raise_if_any(checks.check_dims(profiled), "unusable")
    with pytest.raises(KeyError, match="2_noaction"):
        recordings.read_recordings(profiled, ["state", "action"])
    with pytest.raises(ValueError):
        rebuild.rebuild_from_recordings(recordings.list_recordings(spark, folder=str(flawed)), str(flawed / "out"))


def test_common_fields(spark, tmp_path):
    rng = np.random.default_rng(3)
    for i in range(6):
        arrays = recording(rng, 3)
        if i % 2:
            arrays["env"] = np.ones((3, 2))
        arrays["z_style"] = np.ones((3, 2 if i < 4 else 5))
        np.savez(tmp_path / f"r{i}.npz", **arrays)
    profiled = recordings.profile(recordings.list_recordings(spark, folder=str(tmp_path)))
    fields = ["state", "action", "env", "z_style", "cmd"]
    kept = {row["field"]: row for row in checks.common_fields(profiled, fields).collect()}
    assert [name for name in fields if kept[name]["kept"]] == ["state", "action"]
    assert kept["state"]["shape"] == [64] and kept["cmd"]["shape"] is None
    report = {row["field"]: row.asDict() for row in checks.field_report(profiled, fields).collect()}
    assert set(report) == {"env", "z_style", "cmd"}
    assert report["env"]["missing_examples"] == ["r0.npz", "r2.npz", "r4.npz"]
    assert report["cmd"]["missing_files"] == 6 and report["cmd"]["missing_examples"] == ["r0.npz", "r1.npz", "r2.npz"]
    assert report["z_style"]["inconsistent_files"] == 2
    assert report["z_style"]["inconsistent_examples"] == ["r4.npz", "r5.npz"]
    assert report["z_style"]["missing_files"] == 0


def test_reconcile(spark, folder):
    profiled = recordings.profile(recordings.list_recordings(spark, folder=str(folder)))
    files = recordings.files_table(profiled)
    samples = recordings.read_recordings(profiled, ["state"])
    assert checks.reconcile(samples, files).isEmpty()
    lost = samples.where("not (file_idx = 1 and sample_idx = 3)")
    assert [tuple(row) for row in checks.reconcile(lost, files).collect()] == [(1, 7, 6)]
    doubled = lost.unionByName(samples.where("file_idx = 1 and sample_idx = 4"))
    assert [tuple(row) for row in checks.reconcile(doubled, files).collect()] == [(1, 7, 7)]
    gone = samples.where("file_idx <> 2")
    assert [tuple(row) for row in checks.reconcile(gone, files).collect()] == [(2, 3, 0)]


def test_shards_are_found(spark, folder, tmp_path):
    files = recordings.list_recordings(spark, folder=str(folder))
    built = rebuild.rebuild_from_recordings(files, str(tmp_path / "out"))
    here = datasets.resolve_shards(built.files, str(tmp_path / "out" / "samples"))
    assert here.count() == 6
    elsewhere = datasets.resolve_shards(built.files, str(tmp_path / "moved"))
    assert [r["path"] for r in elsewhere.orderBy("file_idx").collect()] == [
        r["shard_path"] for r in built.files.orderBy("file_idx").collect()
    ]
    lost = built.files.withColumn("shard_path", F.concat(F.lit(str(tmp_path / "gone/")), "name"))
    with pytest.raises(FileNotFoundError, match="file_idx=0"):
        datasets.resolve_shards(lost, str(tmp_path / "moved"))
    for name in NAMES:
        (tmp_path / name.replace(".npz", ".shard")).write_text("x")
    by_stem = datasets.resolve_shards(lost, str(tmp_path), suffix=".shard")
    assert by_stem.where(F.col("path").endswith("/a.shard")).count() == 1


def test_compression(spark, folder, tmp_path):
    files = recordings.list_recordings(spark, folder=str(folder))
    sizes = {}
    for name, level in (("none", None), ("lzf", None), ("gzip", 1), ("gzip", 9)):
        place = tmp_path / f"{name}{level}"
        built = rebuild.rebuild_from_recordings(files, str(place), compression=name, level=level)
        parts = list((Path(built.folder) / "samples").rglob("*.parquet"))
        sizes[name, level] = sum(part.stat().st_size for part in parts)
    assert sizes["gzip", 9] <= sizes["gzip", 1] < sizes["none", None]
    with pytest.raises(ValueError, match="unknown compression"):
        datasets.compression_options("zip")
    assert datasets.compression_options("zip", 1, strict=False)["compression"] == "gzip"


def test_concat_and_summary(spark, folder, tmp_path):
    files = recordings.list_recordings(spark, folder=str(folder))
    built = rebuild.rebuild_from_recordings(files, str(tmp_path / "out"))
    samples, table = datasets.concat_datasets(built, built)
    assert samples.count() == 124
    assert [row["file_offset"] for row in table.orderBy("file_idx").collect()][6:8] == [62, 67]
    assert checks.reconcile(samples, table).isEmpty()
    summary = {row["field"]: row.asDict() for row in datasets.dataset_summary(built.samples).collect()}
    assert summary["action"]["max_shape"] == [16, 29] == summary["action"]["min_shape"]
    assert summary["state_hist"]["max_shape"] == [3, 64] and summary["state"]["num_samples"] == 62
