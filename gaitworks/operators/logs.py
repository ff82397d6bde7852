"""Trial logs: entries of NDJSON lines, heads and tails, messages and their text."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from types import NoneType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.functions.values import ABSENT, VALUE, kind_of, value_array, value_of
from gaitworks.operators.joins import join_lookup
from gaitworks.session import stored

DEFAULT_ENTRIES = 100
#: Spark's own limit for cutting groups before a shuffle; lines counted together beyond it.
MAP_SIDE, LINE_BLOCK = 1000, 10_000


_ENTRY = f"struct<message: {VALUE}, nested: {VALUE}, log: {VALUE}>"
_NAMES = ("message", "nested", "log")
#: Types, as the engine names them, whose text it writes as Python does.
_PLAIN = ("STRING", "BOOLEAN", "VOID")


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, failed, values = [], [], {name: [] for name in _NAMES}
        for row, line in enumerate(batch.column(2).to_pylist()):
            try:
                found = json.loads(line)
            except (ValueError, RecursionError):
                continue
            if not isinstance(found, dict) or ("result" not in found and "error" not in found):
                continue
            result = found.get("result", ABSENT)
            held = result if isinstance(result, dict) else {}
            message = held.get("message", ABSENT)
            nested = message.get("message", ABSENT) if isinstance(message, dict) else ABSENT
            rows.append(row)
            failed.append(result is ABSENT)
            shown = message is ABSENT or isinstance(message, (str, bool, NoneType))
            # of another message its kind counts, and what is in it
            values["message"].append(value_of(message) if shown else (kind_of(message), None))
            values["nested"].append(value_of(nested))
            values["log"].append(value_of(held.get("log", ABSENT)))
        taken = pa.array(rows, pa.int64())
        entry = pa.StructArray.from_arrays([value_array(values[name]) for name in _NAMES], list(_NAMES), mask=pa.array(failed, pa.bool_()))
        columns = [batch.column(0).take(taken), batch.column(1).take(taken), entry, pa.array(failed, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["trial_id", "line_no", "result", "failed"])


#: Stands behind each line when the engine parses it; a line that holds it is left to Python.
_BEHIND = "7046029254386353131"
#: Where the values of a line are, once it is the first item of an array.
_PLACES = {"message": "$[0].result.message", "nested": "$[0].result.message.message", "log": "$[0].result.log"}


#: SQL that turns a type as the engine names it (of a value of ``_PLACES``) into a kind.
_KIND = """CASE WHEN {0} IS NULL THEN NULL WHEN {0} = 'STRING' THEN 'string' WHEN {0} = 'BOOLEAN' THEN 'boolean' WHEN {0} = 'VOID' THEN 'null'
           WHEN startswith({0}, 'OBJECT') THEN 'object' WHEN startswith({0}, 'ARRAY') THEN 'array' ELSE 'number' END"""


def _shown(name: str) -> str:
    """SQL for a value as kind and text, the text as Python writes it; only of the ``_PLAIN`` types."""
    text = f"""CASE _types.{name} WHEN 'STRING' THEN try_variant_get(_v, '{_PLACES[name]}', 'string') WHEN 'VOID' THEN 'None'
               WHEN 'BOOLEAN' THEN if(try_variant_get(_v, '{_PLACES[name]}', 'boolean'), 'True', 'False') END"""
    return f"'{name}', CASE WHEN _types.{name} IS NOT NULL THEN named_struct('kind', {_KIND.format(f'_types.{name}')}, 'text', {text}) END"


def _parsed(lines: DataFrame) -> DataFrame:
    """``trial_id, line_no, result, failed``, and ``odd``: the line itself where Python must read it.

    That is a line which the engine's parser rejects (``NaN`` and repeated
    members among them) though it starts as an object, holds half a surrogate
    pair, or whose text is a number or a container, which Python writes in its
    own way. The parser stops behind a value, so a line is parsed as the first
    item of an array: if something else follows it, so does not the second.

    A generator hands on what is parsed: it keeps the optimizer from merging
    the steps, which would parse a line once for each use.
    """
    wrapped = f"try_parse_json(concat('[', line, ',{_BEHIND}]'))"
    clean = rf"NOT contains(line, '{_BEHIND}') AND NOT (contains(line, r'\u') AND rlike(line, r'\\u[dD][89a-fA-F]'))"
    start = r"startswith(ltrim(' \t\n\r', line), '{')"
    types = ", ".join(f"'{name}', schema_of_variant(try_variant_get(_v, '{place}', 'variant'))" for name, place in _PLACES.items())
    found = f"""named_struct('behind', try_variant_get(_v, '$[1]', 'long'), 'known', try_variant_get(_v, '$[0].result', 'variant') IS NOT NULL,
                'error', try_variant_get(_v, '$[0].error', 'variant') IS NOT NULL, {types})"""
    hard = " OR ".join(f"coalesce(_types.{name}, 'VOID') NOT IN {_PLAIN}" for name in ("nested", "log"))
    odd = f"if(_types.behind IS NULL OR _types.behind <> {_BEHIND} OR {hard}, line, NULL)"
    entry = f"named_struct({', '.join(_shown(name) for name in _PLACES)})"
    parsed = lines.selectExpr("trial_id", "CAST(line_no AS long) AS line_no", "line").where(start)
    parsed = parsed.selectExpr("*", f"explode(array(CASE WHEN {clean} THEN {wrapped} END)) AS _v")
    parsed = parsed.selectExpr("*", f"explode(array({found})) AS _types").withColumn("odd", F.expr(odd))
    return parsed.where("odd IS NOT NULL OR _types.known OR _types.error").selectExpr(
        "trial_id", "line_no", f"CASE WHEN odd IS NULL AND _types.known THEN {entry} END AS result",
        "CASE WHEN odd IS NULL THEN NOT _types.known END AS failed", "odd",
    )


def trial_entries(lines: DataFrame) -> DataFrame:
    """``trial_id, line_no, result`` of the lines that hold a result, up to a trial's first error line.

    Lines are read as Python's decoder reads them: ``NaN`` is a number, and of
    a repeated member the last one counts. Blank, malformed and non-object
    lines are skipped; a line with both a result and an error counts as a
    result. The engine parses each line once, into a stored table; only the
    lines it cannot decide go to Python. The first error is a minimum per trial,
    so that no trial has to be walked through in one task.
    """
    schema = f"trial_id {lines.schema['trial_id'].dataType.simpleString()}, line_no long, result {_ENTRY}, failed boolean"
    engine = stored(_parsed(lines), "log-lines")
    python = stored(engine.where("odd IS NOT NULL").select("trial_id", "line_no", "odd").mapInArrow(_parse, schema), "odd-lines")
    parsed = engine.where("odd IS NULL").drop("odd").unionByName(python)
    errors = parsed.where("failed").groupBy("trial_id").agg(F.min("line_no").alias("_stop"))
    results = parsed.where(~F.col("failed")).select("trial_id", "line_no", "result")
    return (
        join_lookup(results, errors, ["trial_id"], F.col("line_no"), "left")
        .where(F.col("_stop").isNull() | (F.col("line_no") < F.col("_stop")))
        .drop("_stop")
    )


def log_message(entry: Column | str) -> Column:
    """The message of an entry; null when it has none.

    ``message`` as text, or the ``message`` inside it; ``log`` only where there
    is no ``message`` at all. What is no text comes as Python writes it.
    """
    entry = F.col(entry) if isinstance(entry, str) else entry
    message, nested, log = entry["message"], entry["nested"], entry["log"]
    from_message = F.when(message["kind"] == "string", message["text"]).when(message["kind"] == "object", nested["text"])
    return F.when(message.isNotNull(), from_message).otherwise(log["text"])


def log_tail(entries: DataFrame, limit: int = DEFAULT_ENTRIES, end: str = "last") -> DataFrame:
    """The first or last ``limit`` entries of each trial.

    Up to ``MAP_SIDE`` entries Spark cuts each trial on the map side, so a long
    trial does not travel whole. A higher limit is found by counting: blocks of
    line numbers are counted, whole blocks are kept or dropped by the running
    sum of the counts, and only the one block in which the limit falls is ranked.
    """
    if end not in ("first", "last"):
        raise ValueError(f"end must be first or last, not {end!r}")
    place = -F.col("line_no") if end == "last" else F.col("line_no")
    if limit <= MAP_SIDE:
        ranked = Window.partitionBy("trial_id").orderBy(place)
        return entries.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= limit).drop("_rank")
    block = F.call_function("div", place, F.lit(LINE_BLOCK))
    counts = entries.groupBy("trial_id", block.alias("_block")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("trial_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < limit)
    placed = entries.withColumn("_block", block)
    kept = join_lookup(placed, sums, ["trial_id", "_block"], F.col("line_no"))
    whole = kept.where(F.col("_before") + F.col("_n") <= limit).select(*entries.columns)
    inside = Window.partitionBy("trial_id", "_block").orderBy(place)
    cut = kept.where(F.col("_before") + F.col("_n") > limit).withColumn("_rank", F.row_number().over(inside))
    return whole.unionByName(cut.where(F.col("_before") + F.col("_rank") <= limit).select(*entries.columns))


def log_text(entries: DataFrame, limit: int = DEFAULT_ENTRIES, end: str = "first") -> DataFrame:
    """``trial_id, text``: the messages of at most ``limit`` entries, one per line; null without messages."""
    kept = log_tail(entries, limit, end).select("trial_id", "line_no", log_message("result").alias("message"))
    messages = F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("line_no", "message"))))
    joined = F.array_join(F.transform("_messages", lambda entry: entry["message"]), "\n")
    return (
        kept.groupBy("trial_id")
        .agg(messages.alias("_messages"))
        .select("trial_id", F.when(F.size("_messages") > 0, joined).alias("text"))
    )


def first_trials(trials: DataFrame) -> DataFrame:
    """``experiment_id, trial_id`` of each experiment's first trial by position."""
    return trials.groupBy("experiment_id").agg(F.min_by("trial_id", "position").alias("trial_id"))


def first_trial_logs(
    trials: DataFrame, entries: DataFrame, limit: int = DEFAULT_ENTRIES, end: str = "first"
) -> DataFrame:
    """``experiment_id, trial_id, text``: each experiment's log is that of its first trial."""
    first = first_trials(trials)
    wanted = join_lookup(
        entries, first.select("trial_id").distinct(), ["trial_id"], F.col("line_no"), "left_semi"
    )
    return first.join(log_text(wanted, limit, end), "trial_id", "left").select("experiment_id", "trial_id", "text")
