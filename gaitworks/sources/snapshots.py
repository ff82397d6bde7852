"""Snapshot tables of a cluster, read from the JSON, NDJSON and YAML its tools exchange.

Each reader has a parser beside it that takes a DataFrame of payload texts, one
JSON document per row, so that payloads may come from any table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.functions.text import normalize_state, parse_ts, path_name, path_stem
from gaitworks.functions.values import ABSENT, VALUE, as_double, as_long, as_string, is_true, json_text, value_of
from gaitworks.operators.indexing import sample_index
from gaitworks.sources import storage
from gaitworks.sources.payloads import decoded, decoded_files


# The members of an experiment.
EXPERIMENT_MEMBERS = (
    "id",
    "name",
    "state",
    "username",
    "resourcePool",
    "parentId",
    "progress",
    "startTime",
    "endTime",
    "description",
    "config",
    "numTrials",
)


def _values(names: Iterable[str]) -> str:
    return ", ".join(f"`{name}` {VALUE}" for name in names)


def _experiment(item: object) -> Iterator[tuple]:
    if isinstance(item, dict):
        config = json_text(item["config"]) if "config" in item else None
        yield (*[value_of(item.get(name, ABSENT)) for name in EXPERIMENT_MEMBERS], config)


_EXPERIMENT = _values(EXPERIMENT_MEMBERS) + ", _config string"


def _experiments(found: DataFrame) -> DataFrame:
    def text_or(member: str, default: str) -> Column:
        return F.when(F.col(member).isNull(), F.lit(default)).otherwise(as_string(F.col(member)))

    # a stamp that is no text does not look like one either
    return found.select(
        F.when(F.col("id").isNull(), F.lit(0).cast("long")).otherwise(as_long(F.col("id"))).alias("id"),
        text_or("name", "").alias("name"),
        normalize_state(as_string(F.col("state"))).alias("state"),
        text_or("username", "").alias("owner"),
        as_string(F.col("resourcePool")).alias("resource_pool"),
        as_long(F.col("parentId")).alias("parent_id"),
        as_double(F.col("progress")).alias("progress"),
        parse_ts(as_string(F.col("startTime"))).alias("started_at"),
        parse_ts(as_string(F.col("endTime"))).alias("ended_at"),
        as_string(F.col("description")).alias("description"),
        F.col("_config").alias("config"),
        as_long(F.col("numTrials")).try_cast("int").alias("num_trials"),
    ).where(F.col("id").isNotNull())


def experiments(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of ``{"experiments": [...]}``; entries without a readable id are dropped, an absent id is 0."""
    return _experiments(decoded(payloads.select(payload), "experiments", _experiment, _EXPERIMENT, payload))


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """``experiments`` of files of any size, each read by many tasks."""
    return _experiments(decoded_files(spark, path, "experiments", _experiment, _EXPERIMENT))


def _slots_of(agent: object) -> Iterator[tuple]:
    if not isinstance(agent, dict):
        return
    pools_, held = agent.get("resourcePools", ABSENT), agent.get("slots")
    pool = (pools_[0] if pools_ else ABSENT) if isinstance(pools_, list) else pools_
    shared = [value_of(agent.get("id", ABSENT)), value_of(agent.get("label", ABSENT)), value_of(pool)]
    for slot in held.values() if isinstance(held, dict) else held if isinstance(held, list) else ():
        if isinstance(slot, dict):
            box = slot.get("container")
            container = box.get("id", ABSENT) if isinstance(box, dict) else box if isinstance(box, str) else ABSENT
            yield (*shared, *[value_of(slot.get(name, ABSENT)) for name in ("id", "device", "enabled")], value_of(container))


_SLOT = _values(("agent", "label", "pool", "id", "device", "enabled", "held"))


def _slots(found: DataFrame) -> DataFrame:
    return found.select(
        F.coalesce(as_string(F.col("id")), F.lit("None")).alias("slot_id"),
        F.coalesce(as_string(F.col("agent")), F.lit("None")).alias("agent_id"),
        as_string(F.col("label")).alias("agent_label"),
        as_string(F.col("device")).alias("device"),
        F.when(F.col("enabled").isNull(), F.lit(True)).otherwise(is_true(F.col("enabled"))).alias("enabled"),
        as_string(F.col("held")).alias("container_id"),
        as_string(F.col("pool")).alias("resource_pool"),
    )


def slots(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per slot of ``{"agents": [...]}``.

    An agent's slots are an object or an array; its pool is the first of a
    list, or the bare value. ``container_id`` comes from a container object's
    id or a bare string. An absent ``enabled`` is true, a null one false.
    """
    return _slots(decoded(payloads.select(payload), "agents", _slots_of, _SLOT, payload))


def read_slots(spark: SparkSession, path: str) -> DataFrame:
    """``slots`` of files of any size, each read by many tasks."""
    return _slots(decoded_files(spark, path, "agents", _slots_of, _SLOT))


def _pools(found: DataFrame) -> DataFrame:
    return found.select(
        "position",
        F.coalesce(as_string(F.col("name")), F.lit("")).alias("name"),
        as_string(F.col("description")).alias("description"),
    )


_POOL = ("name", "description")


def pools(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``position, name, description`` of ``{"resourcePools": [...]}``; an absent name is empty."""
    return _pools(_listed(payloads.select(payload), "resourcePools", _POOL, payload))


def read_pools(spark: SparkSession, path: str) -> DataFrame:
    """``pools`` of files of any size, each read by many tasks."""
    return _pools(decoded_files(spark, path, "resourcePools", _members(_POOL), _values(_POOL), positions=True))


def _members(names: tuple[str, ...]) -> Callable[[object], Iterator[tuple]]:
    """A row of some members per item; the members of one that is no object are absent."""

    def rows(item: object) -> Iterator[tuple]:
        held = item if isinstance(item, dict) else {}
        yield tuple(value_of(held.get(name, ABSENT)) for name in names)

    return rows


def _listed(payloads: DataFrame, member: str, names: tuple[str, ...], payload: str) -> DataFrame:
    """Every item of a list with its ``position``."""
    return decoded(payloads, member, _members(names), _values(names), payload)


def named_items(payloads: DataFrame, member: str, payload: str = "payload") -> DataFrame:
    """``position, id, name`` of a list of named things, such as ``workspaces`` or ``projects``.

    Other columns of the payloads stay beside them.
    """
    kept = [name for name in payloads.columns if name != payload]
    return _listed(payloads, member, ("id", "name"), payload).select(
        *kept, "position", as_long(F.col("id")).alias("id"), as_string(F.col("name")).alias("name")
    )


def trials(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``experiment_id, trial_id, position`` of ``{"trials": [...]}``, one payload per ``experiment_id``."""
    return _listed(payloads.select("experiment_id", payload), "trials", ("id",), payload).select(
        "experiment_id", as_string(F.col("id")).alias("trial_id"), "position"
    )


def read_trial_lines(spark: SparkSession, path: str) -> DataFrame:
    """``trial_id, line_no, line`` of NDJSON files, one per trial, named by the trial.

    Large files are read in splits; a line's place is its split's start and
    its order within the split.
    """
    lines = spark.read.text(path).select(
        path_stem(F.col("_metadata.file_path")).alias("trial_id"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value").alias("line"),
    )
    return sample_index(lines, ["trial_id"], ["_from", "_seq"], name="line_no").select("trial_id", "line_no", "line")


CONFIG_SCHEMA = "workspace string, project string, readable boolean"


def job_configs(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, workspace, project, readable`` of YAML texts.

    The workspace is ``default`` unless named. A text that is no YAML mapping
    has neither, and stays in the list.
    """

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading job configs needs PyYAML on the executors") from error
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            workspaces, projects, readable = [], [], []
            for content in batch["text"].to_pylist():
                try:
                    config = yaml.load(content, Loader=loader) or {}
                    workspace, project = str(config.get("workspace", "default")), config.get("project")
                    workspaces.append(workspace)
                    projects.append(str(project) if project else None)
                    readable.append(True)
                except Exception:  # noqa: BLE001 - a bad date or too deep a nesting is no reason to fail the others
                    workspaces.append(None)
                    projects.append(None)
                    readable.append(False)
            yield pa.RecordBatch.from_arrays(
                [batch["path"], pa.array(workspaces, pa.string()), pa.array(projects, pa.string()), pa.array(readable)],
                ["path", "workspace", "project", "readable"],
            )

    return texts.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(
        parse, f"path string, {CONFIG_SCHEMA}"
    )


def read_job_configs(spark: SparkSession, folder: str) -> DataFrame:
    """The ``*.yaml`` and ``*.yml`` files of a folder (not below it), in path order.

    Read in tasks; Spark's text source gives no row for an empty file.
    """

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch["folder"].to_pylist():
                paths = [path for path in storage.list_dir(place) if path.endswith((".yaml", ".yml"))]
                yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                system, inner = storage.resolve(path)
                with system.open_input_stream(inner, compression=None) as stream:
                    content = stream.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_pydict({"path": [path], "text": [content]})

    listed = spark.createDataFrame([(storage.absolute(folder),)], "folder string").mapInArrow(expand, "path string")
    spread = listed.repartition(spark.sparkContext.defaultParallelism, "path")
    return job_configs(spread.mapInArrow(load, "path string, text string")).orderBy("path")


def dry_run_submissions(configs: DataFrame) -> DataFrame:
    """The result table of a dry run: each config by name, none sent."""
    return configs.select(
        path_name(F.col("path")).alias("config"),
        F.lit("dry-run").alias("success"),
        F.lit(None).cast("string").alias("experiment_id"),
        F.lit(None).cast("string").alias("error"),
    )
