"""Snapshot sources read from files that tasks write from the given tables.

Orders are experiments in JSON documents, suppliers agents with slots, nations
pools; conversations are trial logs, one NDJSON file each; customers are job
configs in YAML; documents are the files of a project tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.catalog.registry import query, table
from gaitworks.catalog.snapshots import STATE
from gaitworks.functions import text
from gaitworks.operators import logs
from gaitworks.session import scratch_path, setting
from gaitworks.sources import projects, snapshots

_written: dict[tuple[str, str, str], str] = {}
#: Items in a JSON document.
ITEMS = 2000
#: Of files' contents that a Python worker gets at a time.
BATCH_BYTES = 4 << 20


def _write(target: str):
    def write(batches):
        import pyarrow as pa

        from gaitworks.sources import storage

        made: set[str] = set()
        for batch in batches:
            # one name and text at a time, the text as it lies in the batch
            for name, content in zip(batch.column(0), batch.column(1)):
                system, inner = storage.resolve(f"{target}/{name.as_py()}")
                parent = inner.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(inner) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return write


def written(spark: SparkSession, folder: str, kind: str, files) -> str:
    """A folder of files made of ``name, content`` rows, once per session and folder of tables."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _written:
        target = scratch_path(spark, kind)
        rows = files(spark, folder).repartition(spark.sparkContext.defaultParallelism, "name")
        with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
            rows.mapInArrow(_write(target), "n long").agg(F.sum("n")).collect()
        _written[key] = target
    return _written[key]


def _documents(items: DataFrame, key: str, member: str, prefix: str) -> DataFrame:
    """JSON documents of at most ``ITEMS`` items each, in the order of the key."""
    grouped = items.groupBy(F.call_function("div", F.col(key).cast("long"), F.lit(ITEMS)).alias("part"))
    listed = grouped.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), ", ")
    return listed.select(
        F.concat(F.lit(prefix), "part", F.lit(".json")).alias("name"),
        F.concat(F.lit('{"skipped": NaN, "'), F.lit(member), F.lit('": ['), body, F.lit("]}")).alias("content"),
    )


def experiment_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids as numbers, text, absent or unreadable; all kinds of stamps; progress may be no number."""
    stamp = "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")"
    item = F.expr(
        f"""concat('{{',
          case o_orderkey % 11 when 0 then concat('"id": "', o_orderkey, '", ') when 1 then '' when 2 then '"id": "exp-1", '
               else concat('"id": ', o_orderkey, ', ') end,
          case when o_orderkey % 7 = 0 then '' else concat('"name": "', o_orderpriority, '", ') end,
          '"state": "', case o_orderstatus when 'F' then 'STATE_COMPLETED' when 'O' then 'ACTIVE' else 'STATE_LOST' end,
          '", "username": "lost", "username": "', o_custkey, '", "startTime": "', {stamp}, 'Z", "endTime": ',
          case o_orderkey % 5 when 0 then concat('"', {stamp}, 'Z"') when 1 then concat('"', {stamp}, '.000000+00:00"')
               when 2 then concat('"', {stamp}, '"') when 3 then '"soon"' else 'null' end,
          case o_orderkey % 4 when 0 then concat(', "progress": ', o_totalprice) when 1 then ', "progress": NaN' else '' end,
          ', "resourcePool": ', case when o_orderkey % 2 = 0 then concat('"pool', o_custkey % 25, '"') else 'null' end,
          case when o_orderkey % 3 = 0 then concat(', "parentId": ', o_orderkey - 1) else '' end,
          ', "description": "", "numTrials": ', o_orderkey % 9, ', "config": {{"k": [', o_custkey, ', 1.5]}}}}, 3')"""
    )
    items = table(spark, folder, "orders").select("o_orderkey", item.alias("item"))
    return _documents(items, "o_orderkey", "experiments", "experiments_")


@query(
    "A4_read_experiments_files",
    f"""SELECT CASE WHEN o_orderkey % 11 = 1 THEN 0 ELSE o_orderkey END AS id,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS name, {STATE} AS state,
       CAST(o_custkey AS VARCHAR) AS owner, CASE WHEN o_orderkey % 2 = 0 THEN 'pool' || o_custkey % 25 END AS resource_pool,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS parent_id,
       CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN 'NaN'::DOUBLE END AS progress,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS started,
       CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') END AS ended,
       '' AS description, '{{"k":[' || o_custkey || ',1.5]}}' AS config, CAST(o_orderkey % 9 AS INTEGER) AS num_trials
FROM orders WHERE o_orderkey % 11 <> 2""",
)
def read_experiments(spark, folder):
    found = snapshots.read_experiments(spark, written(spark, folder, "experiments", experiment_files))
    stamps = {"started_at": "started", "ended_at": "ended"}
    return found.select(
        *[text.iso_ts(F.col(c)).alias(stamps[c]) if c in stamps else F.col(c) for c in found.columns]
    )


def agent_files(spark: SparkSession, folder: str) -> DataFrame:
    """Agents with two slots, as an object or a list, with a device each; enabled by number, text, null or not at all."""
    slot = """concat('{{"id": "slot', s_suppkey, '.{n}", "device": "gpu{n}"',
        case s_suppkey % 4 when 0 then ', "enabled": 0' when 1 then ', "enabled": "yes"' when 2 then ', "enabled": null' else '' end,
        case s_suppkey % 3 when 0 then concat(', "container": {{"id": ', s_suppkey, '}}') when 1 then ', "container": "c"' else '' end, '}}')"""
    one, two = slot.format(n=1), slot.format(n=2)
    item = F.expr(
        f"""concat('{{"id": ', s_suppkey, ', "label": "', s_name, '", "resourcePools": ["pool', s_nationkey, '"], "slots": ',
          case when s_suppkey % 2 = 0 then concat('{{"a": ', {one}, ', "b": ', {two}, '}}')
               else concat('[', {one}, ', ', {two}, ', 5]') end, '}}')"""
    )
    items = table(spark, folder, "supplier").select("s_suppkey", item.alias("item"))
    return _documents(items, "s_suppkey", "agents", "agents_")


@query(
    "A5_flatten_slots_files",
    """SELECT 'slot' || s_suppkey || '.' || n AS slot_id, CAST(s_suppkey AS VARCHAR) AS agent_id, s_name AS agent_label,
       'gpu' || n AS device, s_suppkey % 4 IN (1, 3) AS enabled,
       CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN 'c' END AS container_id,
       'pool' || s_nationkey AS resource_pool
FROM (SELECT *, unnest([1, 2]) AS n FROM supplier)""",
)
def read_slots(spark, folder):
    return snapshots.read_slots(spark, written(spark, folder, "agents", agent_files))


def pool_files(spark: SparkSession, folder: str) -> DataFrame:
    item = F.to_json(F.struct(F.concat(F.lit("pool"), "n_nationkey").alias("name"), F.col("n_name").alias("description")))
    return _documents(table(spark, folder, "nation").select("n_nationkey", item.alias("item")), "n_nationkey", "resourcePools", "pools_")


@query(
    "A6_read_pools_files",
    """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS position, 'pool' || n_nationkey AS name,
              n_name AS description FROM nation""",
)
def read_pools(spark, folder):
    return snapshots.read_pools(spark, written(spark, folder, "pools", pool_files))


def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """A log file per conversation; messages as text and numbers, beside values that are no numbers."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    line = (
        F.when(F.col("turn") % 5 == 1, F.concat(F.lit('{"result": {"loss": NaN, "message": '), quoted, F.lit("}}")))
        .when(F.col("turn") % 5 == 2, F.concat(F.lit('{"result": {"message": "first", "message": '), quoted, F.lit("}}")))
        .when(F.col("turn") % 5 == 3, F.concat(F.lit('{"result": {"log": '), F.col("turn").cast("string"), F.lit(".0}}")))
        .when(F.col("turn") % 5 == 4, F.lit('{"result": {"log": Infinity}}'))
        .otherwise(F.concat(F.lit('{"result": {"message": {"message": '), quoted, F.lit("}}}")))
    )
    lines = table(spark, folder, "conversations").select("conv_id", "turn", line.alias("line"))
    grouped = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    return grouped.select(
        F.concat(F.col("conv_id").cast("string"), F.lit(".ndjson")).alias("name"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"),
    )


@query(
    "A7_read_trial_logs_files",
    """SELECT CAST(conv_id AS VARCHAR) AS trial_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no,
       CASE turn % 5 WHEN 3 THEN turn || '.0' WHEN 4 THEN 'inf' ELSE text END AS message FROM conversations""",
)
def read_trial_logs(spark, folder):
    lines = snapshots.read_trial_lines(spark, written(spark, folder, "logs", log_files))
    return logs.trial_entries(lines).select("trial_id", "line_no", logs.log_message("result").alias("message"))


def config_files(spark: SparkSession, folder: str) -> DataFrame:
    content = F.expr(
        r"""concat('name: "', c_name, '"\nlabels: [a, b]\n',
              case when c_custkey % 3 = 0 then '' else concat('workspace: ', c_mktsegment, '\n') end,
              case when c_custkey % 5 = 0 then 'project: ""\n' else concat('project: p', c_nationkey, '\n') end,
              case c_custkey % 7 when 6 then 'broken: [1, 2' when 5 then 'day: 2024-13-45\n' else '' end)"""
    )
    ending = F.when(F.col("c_custkey") % 2 == 0, F.lit(".yaml")).otherwise(F.lit(".yml"))
    return table(spark, folder, "customer").select(F.concat("c_name", ending).alias("name"), content.alias("content"))


@query(
    "A8_read_job_configs_files",
    """SELECT c_name || CASE WHEN c_custkey % 2 = 0 THEN '.yaml' ELSE '.yml' END AS name,
         CASE WHEN c_custkey % 7 >= 5 THEN NULL WHEN c_custkey % 3 = 0 THEN 'default' ELSE c_mktsegment END AS workspace,
         CASE WHEN c_custkey % 7 >= 5 OR c_custkey % 5 = 0 THEN NULL ELSE 'p' || c_nationkey END AS project,
         c_custkey % 7 < 5 AS readable
       FROM customer""",
)
def read_job_configs(spark, folder):
    found = snapshots.read_job_configs(spark, written(spark, folder, "configs", config_files))
    return found.select(text.path_name(F.col("path")).alias("name"), "workspace", "project", "readable")


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    path = F.expr(
        """concat(source, case doc_id % 6 when 0 then '/.cache/' when 1 then '/wandb/' when 2 then '/__init__/'
                          when 3 then '/a.b/.' else '/' end, doc_id, '.txt')"""
    )
    return table(spark, folder, "documents").select(path.alias("name"), F.col("text").alias("content"))


@query(
    "A9_project_manifest_files",
    """SELECT path, to_base64(encode(text)) AS content FROM (
         SELECT source || CASE doc_id % 6 WHEN 2 THEN '/__init__/' ELSE '/' END || doc_id || '.txt' AS path, text, doc_id FROM documents)
       WHERE doc_id % 6 IN (2, 4, 5)""",
)
def project_manifest(spark, folder):
    return projects.project_manifest(spark, written(spark, folder, "project", project_files))
