"""JSON documents cut into ranges, against Python's decoder; log lines parsed by the engine, against the same."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gaitworks.functions.values import ABSENT, VALUE, value_of
from gaitworks.operators import logs
from gaitworks.sources import payloads as P
from gaitworks.sources import snapshots

BROKEN = object()


def random_value(draw, depth=0):
    kind = draw.random()
    if depth > 3 or kind < 0.4:
        return draw.choice([1, -2.5, "x", 'a\\"b', "{[,:]}", "\\", "é中", None, True, float("nan"), "", '"', '\\\\"'])
    if kind < 0.7:
        return [random_value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {draw.choice(["a", "items", 'k"', "\\"]): random_value(draw, depth + 1) for _ in range(draw.randrange(4))}


def random_document(draw):
    if draw.random() < 0.1:
        text = json.dumps(random_value(draw))
    else:
        parts = []
        for _ in range(draw.randrange(5)):
            value = random_value(draw, 1) if draw.random() < 0.5 else [random_value(draw, 2) for _ in range(draw.randrange(6))]
            body = json.dumps(value, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, None, 1]))
            parts.append(json.dumps(draw.choice(["items", "items", "x", "y"])) + draw.choice([":", " : "]) + body)
        text = "{" + draw.choice([",", " ,\n"]).join(parts) + "}"
    if draw.random() < 0.4 and text:
        at = draw.randrange(len(text))
        text = draw.choice([text[:at], text[:at] + draw.choice('{}[],:"\\ 1') + text[at:], text[:at] + text[at + 1 :]])
    return text


def python_items(text):
    try:
        document = json.loads(text)
    except ValueError:
        return BROKEN
    held = document.get("items") if isinstance(document, dict) else None
    return held if isinstance(held, list) else []


def range_items(data, size):
    """What the ranges of a file give, one after the other; the state at a range's start is the end of the one before."""

    def read(at, length):
        return data[at : at + length]

    state, found, keys, known = P.State(), [], [], None
    try:
        for start in range(0, max(len(data), 1), size):
            source = P._Source(read, start, min(start + size, len(data)), len(data), state)
            after = source.state
            for what, at, value in P._pieces(source, start == 0, state):
                if what == "item":
                    found.append((at, value))
                elif what == "kind":
                    implied, inner = value
                    if implied not in (set(), {known}):
                        return BROKEN
                    known = inner or known
                else:
                    keys.append((what, at, value))
            solid = data[start : start + size].lstrip(b" \t\n\r")[:1]
            state = P.State(after.in_string, after.depth, state.outer or (solid[0] if solid else 0))
        if state.depth or state.in_string:
            return BROKEN
    except ValueError:
        return BROKEN
    low, high = P._wanted(keys, "items") or (0, 0)
    return [value for at, value in found if low <= at and (high is None or at < high)]


@pytest.mark.parametrize("seed", range(4))
def test_ranges_of_any_size_against_python(monkeypatch, seed):
    draw = random.Random(seed)
    broken = 0
    for _ in range(500):
        text = random_document(draw)
        wanted = python_items(text)
        broken += wanted is BROKEN
        monkeypatch.setattr(P, "AHEAD", draw.choice([1, 3, 64]))
        for size in (1, 2, 3, 7, 50, 1 << 20):
            assert repr(range_items(text.encode(), size)) == repr(wanted), (size, text)
        try:
            whole = list(P._items_of_bytes(text.encode(), "items"))
        except ValueError:
            whole = BROKEN
        assert repr(whole) == repr(wanted), text
    assert 50 < broken < 450


SCHEMA = f"shown string, id {VALUE}"


def read(spark, path, positions, size):
    def rows(item):
        yield (json.dumps(item), value_of(item.get("id", ABSENT)) if isinstance(item, dict) else None)

    found = P.decoded_files(spark, str(path), "items", rows, SCHEMA, positions, size)
    return sorted((r["path"].rsplit("/", 1)[1], *([r["position"]] if positions else []), r["shown"], r["id"] and r["id"]["text"]) for r in found.collect())


@pytest.mark.parametrize("size", [7, 300, 1 << 20])
def test_files_in_ranges(spark, tmp_path, size):
    draw = random.Random(size)
    wanted = []
    for number in range(12):
        text = random_document(draw)
        while python_items(text) is BROKEN:
            text = random_document(draw)
        (tmp_path / f"f{number}.json").write_text(text)
        wanted += [(f"f{number}.json", at, json.dumps(x), (value_of(x["id"]) or (0, 0))[1] if isinstance(x, dict) and "id" in x else None) for at, x in enumerate(python_items(text))]
    assert wanted
    assert read(spark, tmp_path, True, size) == sorted(wanted)
    assert read(spark, tmp_path, False, size) == sorted((name, shown, id_) for name, _, shown, id_ in wanted)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """No task holds the document: each range is a row of its own, and so is each task's share of items."""
    item = '{{"id": {}, "name": "a \\"quoted\\" [name], {{x}}", "state": "ACTIVE", "config": {{"k": [1, 2]}}}}'
    body = ",\n".join(item.format(i) for i in range(40_000))
    (tmp_path / "big.json").write_text('{"experiments": [{"id": -1}], "other": [1, "2", {}], "experiments": [' + body + '], "tail": {"experiments": [5]}}')
    (tmp_path / "small.json").write_text('{"experiments": [{"id": 40000}]}')
    (tmp_path / "none.json").write_text('{"experiments": [{"id": 7}], "experiments": 3}')
    found = P.decoded_files(spark, str(tmp_path), "experiments", snapshots._experiment, snapshots._EXPERIMENT, range_bytes=100_000)
    table = snapshots._experiments(found)
    assert tuple(table.agg(F.count("*"), F.sum("id"), F.min("id")).first()) == (40_001, 40_000 * 40_001 // 2, 0)
    assert table.filter("id = 39999").first()["name"] == 'a "quoted" [name], {x}'
    ranges, _, several = P._ranges(spark, str(tmp_path), 100_000)
    assert several and ranges.count() > 30
    states = ranges.filter("path LIKE '%big.json'").orderBy("start").collect()
    assert max(r["end"] - r["start"] for r in states) == 100_000 and states[0]["depth"] == 0 and all(r["depth"] >= 2 for r in states[1:-1])


@pytest.mark.parametrize(
    "text",
    ['{"items": [1, 2, 3, 4, 5, 6', '{"items": [1, 2, 3, "a": 4, 5]}', '{"items": {"a": 1, 2}, "b": 1}', '{"items": [1, 2}, "a": []]', '{"items": [1, 2]} {"items": []}',
     '{"items": [1, 2, "abc]}', '{"items": [1, 2,, 3]}', '{"items": [1], "other": [nope]}', '{"items": [1]]', "  ", '{"items" [1]}', '["items": [1]]'],
)
@pytest.mark.parametrize("size", [3, 1 << 20])
def test_broken_files_are_errors(spark, tmp_path, text, size):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception, match="no JSON document"):
        read(spark, tmp_path, False, size)


def test_no_files_and_no_items(spark, tmp_path):
    assert read(spark, tmp_path, True, 5) == []
    (tmp_path / "e.json").write_text("")  # Spark's readers pass over an empty file
    assert read(spark, tmp_path, True, 5) == []
    (tmp_path / "f.json").write_text('{"items": [], "more": "' + "x" * 50 + '"}')
    assert read(spark, tmp_path, True, 5) == [] and read(spark, tmp_path, False, 1 << 20) == []


# ---------------------------------------------------------------- log lines


def log_value(draw, depth=0):
    kind = draw.random()
    if kind < 0.35:
        return draw.choice(['"x"', '"é\\u00e9 \\n"', '""', '"a\\"b"', '"\\ud800"', '"\\ud83d\\ude00"', '"/\\/}"', '"null"', '"\\u007d"'])
    if kind < 0.6:
        return draw.choice(["1", "1.0", "1e400", "-0", "1E5", "NaN", "Infinity", "-Infinity", "true", "false", "null", "1" * 42, "0.10", "01", "1."])
    if kind < 0.8 and depth < 3:
        return "[" + ",".join(log_value(draw, depth + 1) for _ in range(draw.randrange(3))) + "]"
    return log_object(draw, depth + 1) if depth < 3 else "1"


def log_object(draw, depth=0):
    keys = [draw.choice(["message", "result", "log", "error", "x"]) for _ in range(draw.randrange(4))]
    return "{" + draw.choice([",", " , "]).join(json.dumps(k) + ":" + log_value(draw, depth) for k in keys) + "}"


ODD_LINES = [
    None, "", "  ", "plain text", '{"result": 1} x', '{"result":1}{"a":2}', '{"result":1}, {"a":2}', '{"result":1}}', '{"result":1}]}', '{"result":{"log":"\\u007d"}}}',
    "[1]", "5", "null", "{", '﻿{"result":{}}', ' \t{"result":{"log":"a"}}\r', " ", '{"result":{"log":"a\tb"}}', '{"result":{"log":"\\x"}}', "{'result':1}",
    '{"result":{"message":"m"},}', '{"result":/*c*/1}', '{"result":' + "[" * 1200 + "]" * 1200 + "}", '{"result":{"message":{"message":[1.50,{"b":1,"a":2}]}}}',
]


def python_entry(line):
    """Whether the line is an entry, and its message."""
    try:
        found = json.loads(line) if line else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict) or "result" not in found:
        return None
    held = found["result"] if isinstance(found["result"], dict) else {}
    message = held.get("message", ABSENT)
    if isinstance(message, dict):
        message = message.get("message", ABSENT)
    elif message is ABSENT:
        message = held.get("log", ABSENT)
    elif not isinstance(message, str):
        message = ABSENT
    return ("entry", None if message is ABSENT else (value_of(message)[1] if message is not None or "message" in held or "log" in held else None))


def test_log_lines_against_python(spark):
    draw = random.Random(3)
    lines = ODD_LINES + [
        draw.choice(['{"result":' + draw.choice([log_object(draw, 1), log_value(draw, 1)]) + draw.choice(["", ',"error":1', ',"result":' + log_object(draw, 1)]) + "}", log_object(draw)])
        for _ in range(1500)
    ]
    table = spark.createDataFrame([(str(i), 0, line) for i, line in enumerate(lines)], "trial_id string, line_no int, line string")
    entries = logs.trial_entries(table)
    got = {int(r["trial_id"]): ("entry", r["m"]) for r in entries.select("trial_id", logs.log_message("result").alias("m")).collect()}
    wanted = {i: python_entry(line) for i, line in enumerate(lines)}

    def shown(pair):
        # the text of null is None, as Python writes it
        return pair and (pair[0], pair[1])

    assert {i: got.get(i) for i in wanted} == {i: shown(x) for i, x in wanted.items()}


def test_plain_lines_stay_in_the_engine(spark):
    plain = ['{"result": {"message": "m %d"}}', '{"result": {"message": {"message": "n %d"}}}', '{"result": {"log": true}}', '{"result": {"message": %d}}', '{"error": {"code": %d}}', "text %d", "", '{"other": %d}']
    odd = ['{"result": {"log": %d}}', '{"result": {"loss": NaN, "message": "m"}}', '{"result": {"message": "a", "message": "b %d"}}']
    lines = [(i, p % i if "%d" in p else p) for i, p in enumerate(plain * 20)] + [(1000 + i, p % i if "%d" in p else p) for i, p in enumerate(odd)]
    table = spark.createDataFrame([("t", i, line) for i, line in lines], "trial_id string, line_no int, line string")
    parsed = logs._parsed(table)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    assert sorted(r["line_no"] for r in parsed.where("odd IS NOT NULL").collect()) == [1000, 1001, 1002]
    entries = logs._parsed(table.where("line_no < 1000")).where("NOT failed")
    assert entries.count() == 80
