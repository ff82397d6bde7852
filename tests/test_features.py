"""Windows, norms and flags on hand-made and random rows, against NumPy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitworks.functions import arrays
from gaitworks.operators import features, indexing, joins
from gaitworks.operators.features import derive
from gaitworks.spec import RolloutSpec


def samples_of(spark, files):
    rows = [
        (file_idx, t, [float(x) for x in row]) for file_idx, state in files.items() for t, row in enumerate(state)
    ]
    return spark.createDataFrame(rows, "file_idx long, sample_idx long, state array<float>").repartition(5)


@pytest.mark.parametrize("block_rows", [1, 2, 3, 7, 64, 4096])
@pytest.mark.parametrize("cond,horizon", [(3, 16), (1, 1), (5, 2)])
def test_windows_against_numpy(spark, block_rows, cond, horizon):
    rng = np.random.default_rng(block_rows * 100 + cond)
    files = {i: rng.normal(size=(n, 4)).astype(np.float32) for i, n in enumerate((1, 2, 3, 17, 40))}
    spec = RolloutSpec(cond_steps=cond, horizon_steps=horizon, state_dim=4, cmd_dim=2)
    rows = derive(samples_of(spark, files), spec, ["state_hist", "cmd_hist", "state_delta"], block_rows).collect()
    assert len(rows) == sum(map(len, files.values()))
    for row in rows:
        state, t = files[row["file_idx"]], row["sample_idx"]
        past = np.clip(np.arange(t - cond + 1, t + 1), 0, len(state) - 1)
        ahead = np.clip(np.arange(t + 1, t + horizon + 1), 0, len(state) - 1)
        np.testing.assert_array_equal(np.array(row["state_hist"], np.float32), state[past])
        np.testing.assert_array_equal(np.array(row["cmd_hist"], np.float32), state[past][:, :2])
        np.testing.assert_array_equal(np.array(row["state_delta"], np.float32), state[ahead] - state[t])


@pytest.mark.parametrize("partitions", [None, 1, 5, 40])
def test_layout_by_offsets_is_in_order_and_equal(spark, partitions):
    rng = np.random.default_rng(5)
    files = {i: rng.normal(size=(n, 4)).astype(np.float32) for i, n in enumerate((9, 300, 2))}
    spec = RolloutSpec(state_dim=4, cmd_dim=2)
    rows = samples_of(spark, files)
    table = indexing.with_offsets(indexing.file_counts(rows))
    hashed = derive(rows, spec, block_rows=16)
    ranged = derive(rows, spec, block_rows=16, offsets=table, partitions=partitions)
    assert hashed.exceptAll(ranged).isEmpty() and ranged.exceptAll(hashed).isEmpty()
    placed = ranged.select("file_idx", "sample_idx", "state_hist", F.monotonically_increasing_id().alias("at"))
    order = [(row["file_idx"], row["sample_idx"]) for row in sorted(placed.collect(), key=lambda row: row["at"])]
    assert order == sorted(order)
    if partitions == 5:
        sizes = ranged.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) == 5 and max(row["count"] for row in sizes) <= 63 + 2 * 16


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("Window ["), plan.count("FileScan")


def test_one_scan_one_shuffle_one_window(spark, tmp_path):
    files = {0: np.ones((5, 64), np.float32)}
    samples_of(spark, files).write.parquet(str(tmp_path / "s"))
    read = spark.read.parquet(str(tmp_path / "s"))
    assert exchanges(derive(read)) == (1, 1, 1)
    table = spark.createDataFrame([(0, 0, 5)], "file_idx long, file_offset long, num_samples long")
    plan = derive(read, offsets=table)._jdf.queryExecution().executedPlan().toString()
    # the samples are scanned once, and so is the stored table of offsets
    assert plan.count("Window [") == 1 and plan.count("FileScan") == 2 and plan.count("state:array") == 1
    # besides the shuffle of the samples there is only the broadcast of the offsets
    assert plan.count("+- Exchange ") == 1 and plan.count("BroadcastExchange") == 1
    assert exchanges(derive(read, features=["cmd", "recovery_flag"])) == (0, 0, 1)


def test_wide_columns_are_not_copied_with_neighbours(spark):
    rows = samples_of(spark, {0: np.ones((40, 4), np.float32)}).withColumn("action", F.lit("wide"))
    framed = features.with_frame(rows, 2, 16, block_rows=8)
    assert framed.where("action is null").isEmpty() and framed.count() == 40


def test_input_partitioned_by_file_is_spread_by_block(spark):
    rows = samples_of(spark, {0: np.ones((40, 4), np.float32)}).repartition("file_idx")
    plan = derive(rows, RolloutSpec(state_dim=4, cmd_dim=2))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(file_idx#\d+L, _block", plan)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_large_lookups_are_salted(spark, how):
    large = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("key"), "id")
    lookup = spark.range(0, 60, 2).select(F.col("id").alias("key"), *([] if how == "left_semi" else [(F.col("id") * 10).alias("x")]))
    broadcast = joins.join_lookup(large, lookup, ["key"], F.col("id"), how)
    salted = joins.join_lookup(large, lookup, ["key"], F.col("id"), how, max_bytes=0)
    assert broadcast.exceptAll(salted).isEmpty() and salted.exceptAll(broadcast).isEmpty()
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()


def test_null_state_is_an_error(spark):
    rows = spark.createDataFrame([(0, 0, [1.0]), (0, 1, None)], "file_idx long, sample_idx long, state array<float>")
    with pytest.raises(Exception, match="null state"):
        derive(rows, RolloutSpec(state_dim=1, cmd_dim=1)).collect()


def test_unknown_feature(spark):
    with pytest.raises(ValueError, match="speed"):
        derive(samples_of(spark, {0: np.ones((1, 64))}), features=["speed"])
    with pytest.raises(ValueError):
        RolloutSpec(state_dim=10, cmd_dim=20)


def just(value, steps):
    value = np.float32(value)
    for _ in range(abs(steps)):
        value = np.nextafter(value, np.float32(np.inf if steps > 0 else -np.inf), dtype=np.float32)
    return value


def test_flag_edges(spark):
    base = np.zeros(64, np.float32)
    cases = []

    def case(want, **values):
        state = base.copy()
        for position, value in values.items():
            state[int(position[1:])] = value
        cases.append((state, want))

    case(0.0)
    for position, threshold in (("p61", 2.2), ("p30", 14.6), ("p60", 0.9)):
        case(0.0, **{position: np.float32(threshold)})
        case(1.0, **{position: just(threshold, 1)})
        case(0.0, **{position: just(threshold, -1)})
        case(1.0, **{position: np.float32(-threshold - 1)})
    case(0.0, p29=np.nan)
    case(1.0, p29=np.nan, p58=5)
    case(1.0, p63=np.inf)
    case(0.0, p28=100)
    rows = samples_of(spark, {0: np.array([state for state, _ in cases])})
    found = {row["sample_idx"]: row["recovery_flag"] for row in derive(rows, features=["recovery_flag"]).collect()}
    assert [found[i] for i in range(len(cases))] == [want for _, want in cases]


def test_norms_of_narrow_state(spark):
    rows = samples_of(spark, {0: np.full((1, 64), 2.0)})
    spec = RolloutSpec(state_dim=60)
    norms = rows.select(*[norm.alias(name) for name, norm in arrays.segment_norms("state", spec).items()]).first()
    assert norms["base_ang_norm"] == 0.0
    assert norms["base_lin_norm"] == np.float32(np.sqrt(8))


@pytest.mark.parametrize("block_rows", [1 << 20, 64, 5])
def test_sample_index_of_a_hot_file(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    rows = []
    for i in range(1200):
        file = 0 if i % 3 == 0 else int(rng.integers(1, 90))
        # clustered times with many ties, which the second column parts
        rows.append((file, int(rng.choice([0, 1, 2, 10**6, 10**12])) + int(rng.integers(0, 3)), i))
    df = spark.createDataFrame(rows, "file long, at long, id long").repartition(6)
    found = indexing.sample_index(df, ["file"], ["at", "id"], block_rows=block_rows)
    wanted = {}
    for file in {row[0] for row in rows}:
        for place, row in enumerate(sorted(row for row in rows if row[0] == file)):
            wanted[row] = place
    assert {(row["file"], row["at"], row["id"]): row["sample_idx"] for row in found.collect()} == wanted


def test_sample_index_needs_numbers(spark):
    with pytest.raises(TypeError, match="order column"):
        indexing.sample_index(spark.createDataFrame([(1, "a")], "f int, t string"), ["f"], ["t"])


def test_global_index(spark):
    values = [f"{i * 7919 % 500:03d}" for i in range(500)]
    df = spark.createDataFrame([(value,) for value in values], "path string").repartition(7)
    found = {row["path"]: row["n"] for row in indexing.global_index(df, ["path"], "n").collect()}
    assert found == {value: place for place, value in enumerate(sorted(values))}


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_offsets_ranges_and_lookup(spark, block):
    counts = [4, 0, 3, 9, 0, 1]
    files = spark.createDataFrame(list(enumerate(counts)), "file_idx long, num_samples long")
    placed = indexing.with_offsets(files, block=block)
    assert [row["file_offset"] for row in placed.orderBy("file_idx").collect()] == [0, 4, 4, 7, 16, 16]
    assert indexing.total_samples(files).first()[0] == 17

    def ranges(cap):
        found = indexing.file_ranges(placed.drop("num_samples"), 17, cap).orderBy("file_idx").collect()
        return [(row["file_idx"], row["start"], row["end"], row["out_offset"]) for row in found]

    assert ranges(None) == [(0, 0, 4, 0), (2, 4, 7, 4), (3, 7, 16, 7), (5, 16, 17, 16)]
    assert ranges(9) == [(0, 0, 4, 0), (2, 4, 7, 4), (3, 7, 9, 7)]
    assert ranges(4) == [(0, 0, 4, 0)] and ranges(0) == ranges(None)

    gaps = spark.createDataFrame([(0, 0, 5), (2, 5, 4), (70_000, 9, 3)], "file_idx long, file_offset long, num_samples long")
    for given in (gaps, gaps.drop("num_samples")):
        found = indexing.file_ranges(given, 12).orderBy("file_idx").collect()
        assert [(row["start"], row["end"], row["out_offset"]) for row in found] == [(0, 5, 0), (5, 9, 5), (9, 12, 9)]

    rows = spark.createDataFrame([(i,) for i in [*range(-1, 19), 3, 3]], "global_row long")
    for size in (None, block):
        found = indexing.locate_samples(rows, placed, bucket=size)
        places = sorted((row["global_row"], row["file_idx"], row["sample_idx"]) for row in found.collect())
        file_of = [i for i, n in enumerate(counts) for _ in range(n)]
        starts = [0, 4, 4, 7, 16, 16]
        wanted = sorted((g, file_of[g], g - starts[file_of[g]]) for g in [*range(17), 3, 3])
        assert places == wanted


def test_cap_comes_before_the_window(spark, tmp_path):
    rng = np.random.default_rng(2)
    files = {0: rng.normal(size=(4, 2)), 1: rng.normal(size=(6, 2)), 2: rng.normal(size=(3, 2))}
    rows = samples_of(spark, files)
    table = indexing.with_offsets(indexing.file_counts(rows))
    capped = indexing.cap_samples(rows, table, 7)
    spec = RolloutSpec(state_dim=2, cmd_dim=1, horizon_steps=3)
    found = derive(capped, spec, ["state_delta"]).orderBy("file_idx", "sample_idx").collect()
    assert [(row["file_idx"], row["sample_idx"]) for row in found] == [(0, t) for t in range(4)] + [(1, t) for t in range(3)]
    assert not np.any(np.array(found[-1]["state_delta"]))
    assert indexing.cap_samples(rows, table, 0).count() == 13
    assert indexing.cap_samples(rows, table, 1).count() == 1 and indexing.cap_samples(rows, table, 99).count() == 13
    rows.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    plan = indexing.cap_samples(stored, table, 7)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(file_idx,1)" in plan
    assert indexing.cap_files(table, 2).count() == 2 and indexing.cap_files(table, None).count() == 3
