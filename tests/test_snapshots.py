"""Snapshot readers, pools, experiments, logs and text functions on hand-made rows."""

import base64
import json
import random
import re
import tracemalloc
from collections import Counter
from datetime import date, datetime, timezone
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitworks.functions import text
from gaitworks.operators import experiments as ops
from gaitworks.operators import logs, matrix, pools
from gaitworks.sources import projects, snapshots


def column(spark, values, type_, build):
    df = spark.createDataFrame([(i, value) for i, value in enumerate(values)], f"i int, x {type_}")
    return [row["y"] for row in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fixed_point_as_python_writes_it(spark):
    rng = random.Random(4)
    values = [0.0, 0.125, 0.375, 2.675, 0.25, 0.05, 0.15, 1.005, 1023.995, 59.95, -0.125, -2.675, 0.005, 0.995, 9.995]
    values += [rng.uniform(0, 1024) for _ in range(2000)] + [rng.randrange(0, 2**20) / 1000 for _ in range(2000)]
    values += [rng.randrange(0, 2**17) / 200 for _ in range(2000)]
    for digits in (1, 2):
        assert column(spark, values, "double", lambda x: text.fixed_point(x, digits)) == [f"{v:.{digits}f}" for v in values]
    assert column(spark, [float("nan"), float("inf"), None], "double", lambda x: text.fixed_point(x, 2)) == ["nan", "inf", None]


def test_sizes_and_durations(spark):
    sizes = {0.0: "0.00 B", 1023.0: "1023.00 B", 1024.0: "1.00 KB", 1536.0: "1.50 KB", 5 * 1024.0**4: "5.00 TB",
             2000 * 1024.0**4: "1.95 PB", 3000 * 1024.0**5: "3000.00 PB", -5.0: "-5.00 B", 1023.999: "1024.00 B"}
    assert column(spark, list(sizes), "double", text.format_size) == list(sizes.values())
    spans = {0.0: "0.0s", 12.34: "12.3s", 59.96: "60.0s", 60.0: "1m 0s", 61.9: "1m 1s", 3599.99: "59m 59s",
             3600.0: "1h 0m 0s", 3661.5: "1h 1m 1s", 90061.0: "25h 1m 1s"}
    assert column(spark, list(spans), "double", text.format_duration) == list(spans.values())


def test_stamps(spark):
    stamps = {
        "2024-03-01T10:20:30Z": datetime(2024, 3, 1, 10, 20, 30),
        "2024-03-01T10:20:30.5+02:00": datetime(2024, 3, 1, 8, 20, 30, 500000),
        "2024-03-01 10:20": datetime(2024, 3, 1, 10, 20),
        "2024-03-01T10": datetime(2024, 3, 1, 10),
        "2024-03-01T10Z": datetime(2024, 3, 1, 10),
        "2024-03-01": datetime(2024, 3, 1),
        "": None, "soon": None, "2024-13-01": None, "2024-3-1": None, "2024": None, "2024-03-01T25:00:00": None,
    }
    found = column(spark, list(stamps), "string", lambda x: F.unix_micros(text.parse_ts(x)))
    wanted = [s and int(s.replace(tzinfo=timezone.utc).timestamp() * 1e6) for s in stamps.values()]
    assert found == wanted
    assert column(spark, ["2024-03-01T10:20:30.500000Z", "2024-03-01", None], "string", lambda x: text.iso_ts(text.parse_ts(x))) == [
        "2024-03-01T10:20:30.500000+00:00", "2024-03-01T00:00:00+00:00", None]


def test_names(spark):
    paths = ["/a/b/c.npz", "c.tar.gz", "/x/.hidden", "plain", "/d.e/f"]
    assert column(spark, paths, "string", text.path_name) == ["c.npz", "c.tar.gz", ".hidden", "plain", "f"]
    assert column(spark, paths, "string", text.path_stem) == ["c", "c.tar", ".hidden", "plain", "f"]
    assert column(spark, ["STATE_ERROR", "ERROR", "error", "", None, "STATE_X"], "string", text.normalize_state) == [
        "ERROR", "ERROR", "UNSPECIFIED", "UNSPECIFIED", "UNSPECIFIED", "UNSPECIFIED"]
    assert column(spark, ["é".encode(), b"a"], "binary", text.decode_names) == ["é", "a"]
    assert column(spark, ["x" * 40, "ab"], "string", lambda x: text.pad_right(x, 4)) == ["x" * 40, "ab  "]


def payload(spark, *documents):
    texts = [(d if isinstance(d, str) else json.dumps(d),) for d in documents]
    return spark.createDataFrame(texts, "payload string")


def test_experiments(spark, tmp_path):
    items = [
        {"id": 1, "name": "a", "state": "STATE_COMPLETED", "username": "u", "startTime": "2024-01-01T00:00:00Z",
         "endTime": "2024-01-02T00:00:00+01:00", "config": {"k": [1]}, "progress": 0.5, "numTrials": 2, "parentId": 9},
        {"id": "12", "state": "WHO"}, {"id": " 13 "}, {"id": "12.5"}, {"id": "x"}, {"id": None}, {"id": 4.9}, {"id": True},
        {}, 7, "text", None, [1], {"id": 5, "name": None, "startTime": 5, "endTime": ""},
    ]
    (tmp_path / "e.json").write_text(json.dumps({"experiments": items}, indent=1))
    found = snapshots.read_experiments(spark, str(tmp_path / "e.json"))
    rows = {row["id"]: row.asDict() for row in found.collect()}
    assert sorted(rows) == [0, 1, 4, 5, 12, 13] and found.count() == 7
    first = rows[1] if rows[1]["name"] else [r.asDict() for r in found.where("name = 'a'").collect()][0]
    assert found.where("id = 1").count() == 2
    first = found.where("name = 'a'").first()
    assert first["state"] == "COMPLETED" and first["owner"] == "u" and json.loads(first["config"]) == {"k": [1]}
    assert (first["progress"], first["num_trials"], first["parent_id"]) == (0.5, 2, 9)
    micros = found.where("name = 'a'").select(F.unix_micros("ended_at")).first()[0]
    assert micros == int(datetime(2024, 1, 1, 23, tzinfo=timezone.utc).timestamp() * 1e6)
    assert rows[5]["name"] is None and rows[12]["name"] == "" and rows[12]["state"] == "UNSPECIFIED"
    assert rows[5]["started_at"] is None and rows[5]["ended_at"] is None
    assert snapshots.experiments(payload(spark, [1], {"experiments": {"id": 1}}, {}, "5", '{"experiments": [{"id": 1}], "experiments": 3}')).isEmpty()


@pytest.mark.parametrize("text_", ["nope", "{", '{"experiments": [{"id": 1}', '{"experiments": [{"id": 1},]}', '{"a": 1} 2', "", '{"a" 1}', "[1, 2"])
def test_broken_payloads_are_errors(spark, text_):
    with pytest.raises(Exception, match="no JSON document"):
        snapshots.experiments(payload(spark, text_)).collect()


def test_payloads_as_python_reads_them(spark):
    text_ = '{"experiments": [{"id": 9}], "x": {}, "experiments" : [ {"id": 1, "progress": NaN, "id": 2}, {"id": 3, "progress": -Infinity, "name": "NaN, {\\u00e9"} ] }'
    rows = {row["id"]: row for row in snapshots.experiments(payload(spark, text_)).collect()}
    assert sorted(rows) == [2, 3] and rows[2]["progress"] != rows[2]["progress"] and rows[3]["progress"] == float("-inf")
    assert rows[3]["name"] == "NaN, {é"


def test_a_payload_of_any_size(spark):
    """158 MB in one document: every entry is there."""
    # made in a task, as a row that large does not pass the driver well
    text_ = F.concat(
        F.lit('{"experiments": ['),
        F.array_join(
            F.transform(F.sequence(F.lit(0), F.lit(399_999)), lambda i: F.concat(F.lit('{"id": '), i, F.lit(', "name": "' + "n" * 340 + '", "state": "ACTIVE"}'))),
            ", ",
        ),
        F.lit("]}"),
    )
    found = snapshots.experiments(spark.range(1).select(text_.alias("payload")))
    assert tuple(found.agg(F.count("*"), F.sum("id"), F.min("state")).first()) == (400_000, 400_000 * 399_999 // 2, "ACTIVE")


def test_slots(spark, tmp_path):
    agents = [
        {"id": "a1", "label": "l", "resourcePools": ["p", "q"], "slots": {
            "0": {"id": "0", "device": "gpu", "enabled": True, "container": {"id": "c"}},
            "1": {"id": "1", "container": {"id": None}}, "2": {"id": "2", "container": "c2"}, "3": 5}},
        {"id": "a2", "resourcePools": "p", "slots": [
            {"id": 7, "enabled": None}, {"enabled": 0}, {"id": "9", "enabled": "yes", "container": ""}, "x"]},
        {"id": "a3", "resourcePools": [], "slots": [{"id": "10", "enabled": False, "container": {}}]},
        {"id": "a4", "resourcePools": None, "slots": 4}, "agent", {"id": "a5"},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"agents": agents}))
    rows = {row["slot_id"]: row for row in snapshots.read_slots(spark, str(tmp_path)).collect()}
    assert set(rows) == {"0", "1", "2", "7", "None", "9", "10"}
    assert (rows["0"]["agent_id"], rows["0"]["agent_label"], rows["0"]["resource_pool"], rows["0"]["device"]) == ("a1", "l", "p", "gpu")
    assert {name: row["enabled"] for name, row in rows.items()} == {
        "0": True, "1": True, "2": True, "7": False, "None": False, "9": True, "10": False}
    assert {name: row["container_id"] for name, row in rows.items()} == {
        "0": "c", "1": None, "2": "c2", "7": None, "None": None, "9": "", "10": None}
    assert rows["7"]["resource_pool"] == "p" and rows["10"]["resource_pool"] is None
    assert snapshots.slots(payload(spark, {"agents": {"id": 1}}, [])).isEmpty()


def pool_table(spark, rows):
    return spark.createDataFrame(rows, "name string, total_slots int, used_slots int, available_slots int, utilization_rate double")


def test_pools(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"resourcePools": [{"name": "p", "description": "d"}, {"name": "idle"}, {}]}))
    named = snapshots.read_pools(spark, str(tmp_path / "p.json"))
    slots = spark.createDataFrame(
        [(True, None, "p"), (True, "c", "p"), (False, None, "p"), (True, None, "p"), (True, None, "else"), (True, None, None)],
        "enabled boolean, container_id string, resource_pool string")
    rows = {row["name"]: row for row in pools.pool_slots(named, slots).collect()}
    assert (rows["p"]["total_slots"], rows["p"]["used_slots"], rows["p"]["available_slots"], rows["p"]["utilization_rate"]) == (4, 2, 2, 0.5)
    assert (rows["idle"]["total_slots"], rows["idle"]["utilization_rate"]) == (0, 0.0)
    line = pools.pool_report(pools.pool_slots(named, slots)).where("name = 'p'").first()["line"]
    assert line == f"{'p':30} free:{2:3d} total:{4:3d} util:{50.0:5.1f}%"


def test_ranking(spark):
    table = pool_table(spark, [("a", 4, 1, 3, 0.25), ("b", 9, 0, 9, 0.0), ("c", 3, 0, 3, 0.0), ("d", 1, 1, 0, 1.0), ("e", 2, 0, 2, 0.0)])

    def names(df):
        return [row["name"] for row in df.collect()]

    assert names(pools.rank_pools(table)) == ["b", "a", "c", "e"]
    assert names(pools.rank_pools(table, prefer=["e", "c", "e"])) == ["e", "c", "b", "a"]
    assert names(pools.rank_pools(table, avoided=["b"], max_pools=2)) == ["a", "c"]
    assert names(pools.rank_pools(table, max_pools=0)) == ["b", "a", "c", "e"]
    assert names(pools.best_pool(table, required_slots=3, prefer=["e"])) == ["b"]
    assert names(pools.best_pool(table, required_slots=10)) == []
    assert len(names(pools.list_pools(table, min_free_slots=5))) == 5
    assert names(pools.list_pools(table, True)) == ["b", "a", "c", "e", "d"]
    avoided = spark.createDataFrame([("a",), ("a",)], "name string")
    assert names(pools.rank_pools(table, avoided=avoided)) == ["b", "c", "e"]
    twice = table.withColumn("position", F.lit(1)).unionByName(table.where("name = 'a'").withColumn("position", F.lit(2)).withColumn("total_slots", F.lit(99)))
    assert pools.pool_stats(twice).where("name = 'a'").first()["total_slots"] == 99


def test_experiment_queries(spark):
    rows = [(i, f"n{i}", state, "me", None) for i, state in enumerate(text.STATES)]
    table = spark.createDataFrame(rows, "id long, name string, state string, owner string, ended_at timestamp")
    classes = {row["state"]: row["c"] for row in table.select("state", ops.experiment_class(F.col("state")).alias("c")).collect()}
    assert {s for s, c in classes.items() if c == "active"} == set(ops.ACTIVE) and classes["PAUSED"] is None
    assert ops.by_state(table, ["ERROR"], ["paused"]).count() == 1 and ops.by_state(table, [], ["paused"]).count() == 1
    assert ops.by_state(table).count() == 16 and ops.in_class(table, "failed").count() == 3
    assert [r["id"] for r in ops.page(table, limit=3, offset=2).collect()] == [2, 3, 4]
    assert [r["id"] for r in ops.page(table, limit=3, offset=10**9).collect()] == []
    assert ops.one_by_id(table, 99).isEmpty()
    line = ops.experiment_report(table.where("id = 3")).first()["line"]
    assert line == f"{3:6d} {'STOPPING_KILLED':15} {'me':15} n3"
    ended = table.withColumn("ended_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert ops.old_completed(ended, F.lit("2024-01-31 00:00:00"), 30).isEmpty()
    assert ops.old_completed(ended, datetime(2024, 1, 31, 0, 0, 1), 30).count() == 1


PAGE_TYPES = "id int, name string, at timestamp, day date, price decimal(9,2), score double, raw binary, flag boolean, tags array<string>, local timestamp_ntz"


@pytest.mark.parametrize("sorted_rows,pivots", [(1, 1), (5, 3), (30, 32), (10_000, 32)])
def test_pages_at_any_depth(spark, sorted_rows, pivots):
    """Pages beside each other hold all rows once, in order, with nulls, ties and repeated rows."""
    draw = random.Random(sorted_rows)
    rows = [
        (
            draw.choice([None, *range(6)]), draw.choice([None, "a", "ä", ""]), draw.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 5)]),
            draw.choice([None, date(2020, 1, 1)]), draw.choice([Decimal("1.50"), Decimal("-2.00")]), draw.choice([0.5, float("nan"), None]),
            draw.choice([b"a", b""]), draw.choice([True, False]), draw.choice([["x"], [], None]), datetime(2024, 1, 1, 0, 0, draw.randrange(2)),
        )
        for _ in range(60)
    ]
    rows += [rows[0]] * 40
    table = spark.createDataFrame(rows, PAGE_TYPES).repartition(5)
    pages = [row for at in range(0, 110, 20) for row in ops.page(table, limit=20, offset=at, sorted_rows=sorted_rows, pivots=pivots).collect()]
    assert len(pages) == 100 and Counter(map(str, pages)) == Counter(map(str, table.collect()))
    ids = [-1 if row["id"] is None else row["id"] for row in pages]
    assert ids == sorted(ids)
    assert list(map(str, pages)) == list(map(str, ops.page(table, limit=1000).collect()))
    assert ops.page(table, limit=5, offset=100, sorted_rows=sorted_rows).isEmpty() and ops.page(table.limit(0)).isEmpty()


def test_a_deep_page_sorts_only_what_it_must(spark):
    table = spark.range(0, 300_000, numPartitions=4).select((F.col("id") * 7919 % 300_000).alias("id"), F.lit("x").alias("name"))
    found = ops.page(table, limit=4, offset=200_000, sorted_rows=1000)
    assert [row["id"] for row in found.collect()] == [200_000, 200_001, 200_002, 200_003]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Existing RDD" not in plan
    assert "Filter" in plan and int(re.search(r"offset=(\d+)", plan)[1]) <= 1000


def test_named_items_and_trials(spark):
    named = snapshots.named_items(payload(spark, {"workspaces": [{"id": 3, "name": "w"}, 5, {"name": "v"}]}, "5"), "workspaces")
    assert [tuple(row) for row in named.orderBy("position").collect()] == [(0, 3, "w"), (1, None, None), (2, None, "v")]
    documents = [(1, json.dumps({"trials": [{"id": 12}, {"id": 11}]})), (2, json.dumps({"trials": []}))]
    trials = snapshots.trials(spark.createDataFrame(documents, "experiment_id int, payload string"))
    assert [tuple(row) for row in logs.first_trials(trials).collect()] == [(1, "12")]


def test_reports(spark):
    table = spark.createDataFrame([(1, "a", "ERROR", "me", "long"), (2, "b", "ERROR", "me", "")], "id long, name string, state string, owner string, description string")
    lines = [row["line"] for row in ops.experiment_report(table, show_description=True).orderBy("id").collect()]
    assert lines == [f"{1:6d} {'ERROR':15} {'me':15} a\n    long", f"{2:6d} {'ERROR':15} {'me':15} b"]
    sent = spark.createDataFrame([("c.yaml", "True", "7", None), ("d.yaml", "False", None, "no")], "config string, success string, experiment_id string, error string")
    assert [row["line"] for row in ops.submission_report(sent).orderBy("config").collect()] == ["[OK] c.yaml -> 7", "[FAIL] d.yaml\n    no"]


def test_projects_by_name(spark):
    workspaces = spark.createDataFrame([("w", 0, 5), ("w", 1, 6), ("v", 2, 7)], "name string, position int, id int")
    table = spark.createDataFrame(
        [("p", 0, 6, 60), ("p", 1, 5, 51), ("p", 2, 5, 52)], "name string, position int, workspace_id int, id int")
    assert [row["id"] for row in ops.find_project(workspaces, table, "w", "p").collect()] == [51]
    assert ops.find_project(workspaces, table, "none", "p").isEmpty()
    configs = spark.createDataFrame([("w", "p"), ("w", "q"), ("w", "q"), ("w", None), ("w", "")], "workspace string, project string")
    known = spark.createDataFrame([("w", "p")], "workspace string, project string")
    assert [tuple(row) for row in ops.missing_projects(configs, known).collect()] == [("w", "q")]
    sent = spark.createDataFrame([("True",), ("dry-run",), ("False",), (None,)], "success string")
    assert tuple(ops.submission_summary(sent).first()) == (4, 2, 2)


LINES = [
    '{"result": {"message": "one"}}', "", "not json", "5", "null", '["result"]', '"result"',
    '{"result": {"message": {"message": "two"}}}', '{"result": {"log": "three"}}',
    '{"result": {"message": 4, "log": "hidden"}}', '{"result": {"message": null, "log": "hidden"}}',
    '{"result": {"message": ""}, "error": "both"}', '{"result": {"message": {"message": true}}}', '{"result": "bare"}',
    '{"result": {"log": 7}}', '{"error": "stop"}', '{"result": {"message": "late"}}',
]


def test_trial_logs(spark, tmp_path):
    (tmp_path / "t1.ndjson").write_text("\n".join(LINES) + "\n")
    (tmp_path / "t2.ndjson").write_text('{"result": {"message": 1}}\n')
    (tmp_path / "t3.ndjson").write_text("\n".join(f'{{"result": {{"message": "m{i}"}}}}' for i in range(250)))
    lines = snapshots.read_trial_lines(spark, str(tmp_path))
    assert [row["line"] for row in lines.where("trial_id = 't1'").orderBy("line_no").collect()] == LINES
    assert [row["line_no"] for row in lines.where("trial_id = 't1'").orderBy("line_no").collect()] == list(range(len(LINES)))
    entries = logs.trial_entries(lines)
    assert entries.where("trial_id = 't1'").count() == 9
    texts = {row["trial_id"]: row["text"] for row in logs.log_text(entries).collect()}
    assert texts["t1"] == "one\ntwo\nthree\n\nTrue\n7"
    assert texts["t2"] is None
    assert texts["t3"] == "\n".join(f"m{i}" for i in range(100))
    last = {row["trial_id"]: row["text"] for row in logs.log_text(entries, 2, "last").collect()}
    assert last["t3"] == "m248\nm249" and last["t1"] == "7"
    with pytest.raises(ValueError):
        logs.log_tail(entries, end="middle")
    trials = spark.createDataFrame([(1, "t3", 1), (1, "t1", 0), (2, "t9", 0)], "experiment_id int, trial_id string, position int")
    found = {row["experiment_id"]: row["text"] for row in logs.first_trial_logs(trials, entries).collect()}
    assert found == {1: texts["t1"], 2: None}


def test_lines_as_python_reads_them(spark):
    texts = ['{"result": {"message": "loss", "loss": NaN}}', '{"result": {"message": "a", "message": "b"}}', '{"result": {"log": 1.0}}',
             '{"result": {"log": 1e20}}', '{"result": {"log": Infinity}}', '{"result": {"log": false}}', '{"result": {"log": [1, {"a": null}]}}',
             '{"result": {"message": {"message": 1.50}}}', '{"result": {"log": 100000000000000000000000}}', '{"result": null}']
    lines = spark.createDataFrame([("t", i, line) for i, line in enumerate(texts)], "trial_id string, line_no int, line string")
    found = logs.trial_entries(lines).select("line_no", logs.log_message("result").alias("m")).orderBy("line_no").collect()
    assert [row["m"] for row in found] == [
        "loss", "b", "1.0", "1e+20", "inf", "False", '[1,{"a":null}]', "1.5", "100000000000000000000000", None]


@pytest.mark.parametrize("end", ["first", "last"])
def test_long_tails_are_found_by_counting(spark, monkeypatch, end):
    monkeypatch.setattr(logs, "MAP_SIDE", 5)
    monkeypatch.setattr(logs, "LINE_BLOCK", 7)
    rows = [(t, i * 3) for t, n in (("hot", 200), ("short", 4), ("even", 21)) for i in range(n)]
    entries = spark.createDataFrame(rows, "trial_id string, line_no long")
    for limit in (6, 21, 50, 1000):
        found = logs.log_tail(entries, limit, end)
        got = {}
        for row in found.collect():
            got.setdefault(row["trial_id"], []).append(row["line_no"])
        for t, n in (("hot", 200), ("short", 4), ("even", 21)):
            whole = [i * 3 for i in range(n)]
            assert sorted(got[t]) == (whole[:limit] if end == "first" else whole[-limit:])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(trial_id#" in plan and "_block" in plan


def test_lines_in_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("\n".join(f"line {i}" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = snapshots.read_trial_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [row["line"] for row in rows] == [f"line {i}" for i in range(3000)]


def test_job_configs(spark, tmp_path):
    files = {"a.yaml": "workspace: w\nproject: 7\n", "b.yml": "", "c.yaml": "project: p", "d.yaml": "x: [1", "e.yaml": "- 1\n",
             "f.yml": "workspace:\nproject: ''", "g.txt": "workspace: no",
             "h.yaml": "d: 2024-13-45", "i.yaml": "[" * 3000}
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    found = [tuple(row)[1:] for row in snapshots.read_job_configs(spark, str(tmp_path)).collect()]
    assert found == [("w", "7", True), ("default", None, True), ("default", "p", True), (None, None, False), (None, None, False), ("None", None, True),
                     (None, None, False), (None, None, False)]
    dry = snapshots.dry_run_submissions(snapshots.read_job_configs(spark, str(tmp_path)))
    assert tuple(ops.submission_summary(dry).first()) == (8, 8, 0)


def test_project_manifest(spark, tmp_path):
    root = tmp_path / ".home" / "project"
    for name in ("main.py", "pkg/__init__.py", "pkg/_private.py", ".git/config", "a/.secret", "wandb/run", "a/__pycache__/x.pyc", "a/b/big.bin"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode() * 50)
    (root / "dangling.py").symlink_to(root / "nowhere")
    found = {row["path"]: row["content"] for row in projects.project_manifest(spark, str(root)).collect()}
    assert set(found) == {"main.py", "pkg/__init__.py", "pkg/_private.py", "a/b/big.bin"}
    assert all(content == base64.b64encode(path.encode() * 50).decode() for path, content in found.items())


@pytest.mark.parametrize("texts", [["\u0436" * 500_000 + str(i) for i in range(30)] + ["", "a\r\nb"], ["", ""]])
def test_files_are_written_without_a_copy_of_their_batch(tmp_path, texts):
    import pyarrow as pa

    from gaitworks.catalog import documents

    names = [f"a/{i}.txt" for i in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "content"])
    tracemalloc.start()
    try:
        made = list(documents._write(str(tmp_path))([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [b.to_pydict() for b in made] == [{"n": [len(texts)]}]
    assert [(tmp_path / name).read_bytes() for name in names] == [text_.encode() for text_ in texts]
    # 30 MB of text: much less than one in ten of it was ever held beside the batch
    assert peak < 2_000_000


@pytest.mark.parametrize("tile", [3, 128])
def test_matrix_product(spark, tile):
    rng = np.random.default_rng(tile)
    left = rng.normal(size=(7, 11)) * (rng.random((7, 11)) < 0.5)
    right = rng.normal(size=(11, 5)) * (rng.random((11, 5)) < 0.5)

    def cells(m, a, b):
        return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], f"{a} long, {b} long, v double")

    found = matrix.matrix_product(cells(left, "i", "k"), cells(right, "k", "j"), tile)
    wanted = left @ right
    got = {(row["i"], row["j"]): row["v"] for row in found.collect()}
    met = (left != 0).astype(int) @ (right != 0).astype(int)
    assert set(got) == set(zip(*map(lambda a: a.tolist(), np.nonzero(met))))
    for (i, j), value in got.items():
        assert value == pytest.approx(wanted[i, j], abs=1e-12)
    assert matrix.checksum(found).first()[0] == pytest.approx(wanted.sum())
    halves = cells(left, "i", "k").withColumn("v", F.col("v") / 2)
    doubled = matrix.matrix_product(halves.unionByName(halves), cells(right, "k", "j"), tile)
    assert matrix.checksum(doubled).first()[0] == pytest.approx(wanted.sum())


@pytest.mark.parametrize("grid_tiles", [1, 2, 32])
def test_matrix_products_in_a_grid(spark, grid_tiles):
    """A narrow inner dimension, one with a hot range of k, and rows and columns far apart."""
    rng = np.random.default_rng(2)

    def cells(entries, a, b):
        return spark.createDataFrame([(i, j, v) for (i, j), v in entries.items()], f"{a} long, {b} long, v double")

    left = {(int(i), int(k)): float(rng.normal()) for i in [*range(40), 1 << 40, -7] for k in ([0, 1, 2] if i % 3 else [0, 90])}
    right = {(int(k), int(j)): float(rng.normal()) for k in (0, 1, 90, 91) for j in ([*range(30), -(1 << 41)] if k == 0 else [3, 17])}
    found = matrix.matrix_product(cells(left, "i", "k"), cells(right, "k", "j"), 4, grid_tiles)
    got = {(row["i"], row["j"]): row["v"] for row in found.collect()}
    wanted = {}
    for (i, k), x in left.items():
        for (k2, j), y in right.items():
            if k == k2:
                wanted[i, j] = wanted.get((i, j), 0.0) + x * y
    assert set(got) == set(wanted) and all(got[c] == pytest.approx(wanted[c]) for c in wanted)
    parts = {row["k"]: (row["down"], row["across"]) for row in matrix.grids(cells(left, "i", "k"), cells(right, "k", "j"), 4, grid_tiles).collect()}
    # 12 tile rows meet 9 tile columns at k 0 to 3; elsewhere there are 11 tile rows at most, and 2 tile columns
    assert parts.get(0) == {1: (12, 9), 2: (6, 5), 32: None}[grid_tiles]


def test_a_narrow_product_is_spread_and_a_small_one_not_copied(spark):
    wide = spark.range(4000).select(F.col("id").alias("i"), (F.col("id") % 4).alias("k"), F.lit(1.0).alias("v"))
    across = wide.select("k", F.col("i").alias("j"), "v")
    parts = matrix.grids(wide, across, 4, 32).collect()
    assert [(row["k"], row["down"] * row["across"] > 16) for row in parts] == [(0, True)]
    total = matrix.checksum(matrix.matrix_product(wide, across, 4, 32)).first()[0]
    assert total == 4 * 1000 * 1000
    small = matrix.matrix_product(wide.where("i < 100"), across.where("j < 100"), 4, 32)
    assert "explode" not in small._jdf.queryExecution().optimizedPlan().toString().lower()
