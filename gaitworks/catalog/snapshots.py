"""Snapshot operators over the given tables.

Nations are pools and suppliers are slots; orders are experiments;
conversations are trials with logs; documents are project files; labels are
submission results. Payload texts are built from the tables, so that the
parsers see every kind of value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.catalog.registry import long, query, table
from gaitworks.functions import text
from gaitworks.operators import experiments as ops
from gaitworks.operators import logs, pools
from gaitworks.sources import projects, snapshots

AS_OF = "1999-06-01 00:00:00"
PREFER = ["pool7", "pool3", "pool99"]
AVOID = ["pool1", "pool8"]

POOLS = """slots AS (
  SELECT 'pool' || s_nationkey AS name, NOT (s_suppkey % 7 <> 0 AND NOT s_acctbal < 0) AS used FROM supplier),
counts AS (SELECT name, CAST(count(*) AS INTEGER) AS total_slots, CAST(count_if(used) AS INTEGER) AS used_slots
           FROM slots GROUP BY name),
pools AS (
  SELECT 'pool' || n_nationkey AS name, n_name AS description, coalesce(total_slots, 0) AS total_slots,
         coalesce(used_slots, 0) AS used_slots, coalesce(total_slots - used_slots, 0) AS available_slots,
         CASE WHEN coalesce(total_slots, 0) = 0 THEN 0.0 ELSE CAST(used_slots AS DOUBLE) / total_slots END
           AS utilization_rate
  FROM nation LEFT JOIN counts ON counts.name = 'pool' || n_nationkey)"""


def slots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_name").alias("slot_id"),
        (F.col("s_suppkey") % 7 != 0).alias("enabled"),
        F.when(F.col("s_acctbal") < 0, F.col("s_name")).alias("container_id"),
        F.concat(F.lit("pool"), "s_nationkey").alias("resource_pool"),
    )


def pool_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.concat(F.lit("pool"), "n_nationkey").alias("name"), F.col("n_name").alias("description")
    )


def all_pools(spark: SparkSession, folder: str) -> DataFrame:
    return pools.pool_slots(pool_names(spark, folder), slots(spark, folder))


@query("I1_pool_counts", f"WITH {POOLS} SELECT * FROM counts")
def pool_counts(spark, folder):
    return pools.pool_counts(slots(spark, folder))


@query("G1_pool_slots", f"WITH {POOLS} SELECT * FROM pools")
def pool_slots(spark, folder):
    return all_pools(spark, folder)


@query(
    "I2_utilization",
    """SELECT p_brand, CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count_if(p_size < 25) AS DOUBLE) / count(*) END
         AS utilization_rate FROM part GROUP BY p_brand""",
)
def utilization(spark, folder):
    counted = table(spark, folder, "part").groupBy("p_brand").agg(
        F.count_if(F.col("p_size") < 25).alias("used"), F.count("*").alias("total")
    )
    return counted.select("p_brand", pools.utilization(F.col("used"), F.col("total")).alias("utilization_rate"))


@query(
    "I3_pool_stats",
    """SELECT c_mktsegment AS name, CAST(c_nationkey AS BIGINT) AS total_slots, c_name AS description FROM customer
       QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey DESC) = 1""",
)
def pool_stats(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("position"),
        F.col("c_mktsegment").alias("name"),
        long("c_nationkey").alias("total_slots"),
        F.col("c_name").alias("description"),
    )
    return pools.pool_stats(rows)


@query(
    "G6_avoid_pools",
    f"""WITH {POOLS} SELECT * FROM pools
        WHERE name NOT IN (SELECT 'pool' || c_nationkey FROM customer WHERE c_acctbal > 9900)""",
)
def avoid_pools(spark, folder):
    rich = table(spark, folder, "customer").where(F.col("c_acctbal") > 9900)
    return pools.avoid_pools(all_pools(spark, folder), rich.select(F.concat(F.lit("pool"), "c_nationkey").alias("name")))


@query(
    "F7_available_pools",
    f"WITH {POOLS} SELECT * FROM pools WHERE name NOT IN ('pool1', 'pool8') AND available_slots >= 3",
)
def available_pools(spark, folder):
    return pools.available_pools(all_pools(spark, folder), AVOID, 3)


RANKED = """ranked AS (
  SELECT * FROM pools WHERE name NOT IN ('pool1', 'pool8') AND available_slots >= {free}
  ORDER BY CASE name WHEN 'pool7' THEN 0 WHEN 'pool3' THEN 1 WHEN 'pool99' THEN 2 ELSE 3 END,
           available_slots DESC, name LIMIT {top})"""


@query("H1_rank_pools", f"WITH {POOLS}, {RANKED.format(free=1, top=7)} SELECT * FROM ranked")
def rank_pools(spark, folder):
    return pools.rank_pools(all_pools(spark, folder), AVOID, 1, PREFER, max_pools=7)


@query("H2_best_pool", f"WITH {POOLS}, {RANKED.format(free=2, top=1)} SELECT * FROM ranked")
def best_pool(spark, folder):
    return pools.best_pool(all_pools(spark, folder), 2, PREFER, AVOID)


@query(
    "K9_pool_report_line",
    f"""WITH {POOLS} SELECT name, rpad(name, 30, ' ') || ' free:' || lpad(CAST(available_slots AS VARCHAR), 3, ' ')
          || ' total:' || lpad(CAST(total_slots AS VARCHAR), 3, ' ') || ' util:'
          || lpad(format('{{:.1f}}', utilization_rate * 100), 5, ' ') || '%' AS line FROM pools""",
)
def pool_report(spark, folder):
    return pools.pool_report(pools.list_pools(all_pools(spark, folder)))


@query(
    "A5_flatten_slots",
    """SELECT 'slot' || s_suppkey || '.' || n AS slot_id, 'agent' || s_suppkey AS agent_id,
       CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS agent_label,
       CASE s_suppkey % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE n = 1 END AS enabled,
       CASE WHEN s_suppkey % 4 = 0 THEN 'c' || s_suppkey WHEN s_suppkey % 4 = 1 THEN '' END AS container_id,
       CASE s_suppkey % 5 WHEN 0 THEN NULL ELSE 'pool' || s_nationkey END AS resource_pool
FROM (SELECT *, unnest([1, 2]) AS n FROM supplier) WHERE s_suppkey % 3 <> 2""",
)
def flatten_slots(spark, folder):
    """One payload per supplier; its slots are an object, an array or (giving nothing) a number."""

    def slot(n: int):
        enabled = F.expr(
            f"""case s_suppkey % 6 when 0 then ', "enabled": null' when 1 then ''
                when 2 then ', "enabled": true' else ', "enabled": {"true" if n == 1 else "false"}' end"""
        )
        container = F.expr(
            """case s_suppkey % 4 when 0 then concat(', "container": {"id": "c', s_suppkey, '"}')
               when 1 then ', "container": ""' when 2 then ', "container": {"x": 1}' else '' end"""
        )
        name = F.concat(F.lit('{"id": "slot'), "s_suppkey", F.lit(f'.{n}"'))
        return F.concat(name, enabled, container, F.lit("}"))

    many = F.expr("s_suppkey % 3")
    agent_slots = (
        F.when(many == 0, F.concat(F.lit('{"a": '), slot(1), F.lit(', "b": '), slot(2), F.lit(', "c": 5}')))
        .when(many == 1, F.concat(F.lit("["), slot(1), F.lit(", "), slot(2), F.lit(', "odd"]')))
        .otherwise(F.lit("7"))
    )
    pool = F.concat(F.lit('"pool'), "s_nationkey", F.lit('"'))
    agent_pools = (
        F.when(F.expr("s_suppkey % 5 = 0"), F.lit("[]"))
        .when(F.expr("s_suppkey % 5 = 1"), pool)
        .otherwise(F.concat(F.lit("["), pool, F.lit(', "other"]')))
    )
    label = F.when(F.expr("s_suppkey % 2 = 0"), F.concat(F.lit(', "label": "'), "s_name", F.lit('"'))).otherwise(F.lit(""))
    payload = F.concat(
        F.lit('{"agents": [{"id": "agent'), "s_suppkey", F.lit('"'), label,
        F.lit(', "resourcePools": '), agent_pools, F.lit(', "slots": '), agent_slots, F.lit("}]}"),
    )
    found = snapshots.slots(table(spark, folder, "supplier").select(payload.alias("payload")))
    return found.drop("device")


@query(
    "A6_read_pools",
    """SELECT 'pool' || n_nationkey AS name, CASE WHEN n_regionkey <> 0 THEN n_name END AS description FROM nation
       UNION ALL SELECT '', NULL FROM nation""",
)
def read_pools(spark, folder):
    named = F.struct(
        F.concat(F.lit("pool"), "n_nationkey").alias("name"),
        F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("description"),
    )
    bare = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("description"))
    payload = F.to_json(F.struct(F.array(named, bare).alias("resourcePools")))
    found = snapshots.pools(table(spark, folder, "nation").select(payload.alias("payload")))
    return found.select("name", "description")


STATE = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ACTIVE' ELSE 'UNSPECIFIED' END"
EXPERIMENTS = f"""experiments AS (
  SELECT o_orderkey AS id, o_orderpriority AS name, {STATE} AS state, CAST(o_custkey AS VARCHAR) AS owner,
         o_orderdate AS ended_at FROM orders)"""


@query(
    "A4_read_experiments",
    f"""SELECT CASE WHEN o_orderkey % 11 = 1 THEN 0 ELSE o_orderkey END AS id,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS name, {STATE} AS state,
       CAST(o_custkey AS VARCHAR) AS owner,
       CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') END AS ended,
       CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS progress
FROM orders WHERE o_orderkey % 11 <> 2""",
)
def read_experiments(spark, folder):
    """One payload per order, with ids as number, text, absent or unreadable, and all kinds of stamps."""
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    key = F.col("o_orderkey")
    end = (
        F.when(key % 5 == 0, F.concat(F.lit('"'), stamp, F.lit('Z"')))
        .when(key % 5 == 1, F.concat(F.lit('"'), stamp, F.lit('.000000+00:00"')))
        .when(key % 5 == 2, F.concat(F.lit('"'), stamp, F.lit('"')))
        .when(key % 5 == 3, F.lit('"soon"'))
        .otherwise(F.lit("null"))
    )
    id_ = (
        F.when(key % 11 == 0, F.concat(F.lit('"id": "'), key, F.lit('", ')))
        .when(key % 11 == 1, F.lit(""))
        .when(key % 11 == 2, F.lit('"id": "exp-1", '))
        .otherwise(F.concat(F.lit('"id": '), key, F.lit(", ")))
    )
    name = F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"name": "'), "o_orderpriority", F.lit('", ')))
    state = F.expr("case o_orderstatus when 'F' then 'STATE_COMPLETED' when 'O' then 'ACTIVE' else 'STATE_LOST' end")
    progress = F.when(key % 3 == 0, F.concat(F.lit(', "progress": '), "o_totalprice")).otherwise(F.lit(""))
    payload = F.concat(
        F.lit('{"experiments": [{'), id_, name, F.lit('"state": "'), state, F.lit('", "username": "'), "o_custkey",
        F.lit('", "endTime": '), end, progress, F.lit("}, 3]}"),
    )
    found = snapshots.experiments(table(spark, folder, "orders").select(payload.alias("payload")))
    return found.select("id", "name", "state", "owner", text.iso_ts(F.col("ended_at")).alias("ended"), "progress")


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    raw = F.when(status == "F", F.lit("STATE_COMPLETED")).when(status == "O", F.lit("ACTIVE")).otherwise(F.lit("LOST"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("name"),
        text.normalize_state(raw).alias("state"),
        F.col("o_custkey").cast("string").alias("owner"),
        F.col("o_orderdate").cast("timestamp").alias("ended_at"),
    )


def _plain(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "state", "owner", text.iso_ts(F.col("ended_at")).alias("ended"))


PLAIN = "id, name, state, owner, strftime(ended_at, '%Y-%m-%dT%H:%M:%S+00:00') AS ended"


@query("F3_by_state", f"WITH {EXPERIMENTS} SELECT {PLAIN} FROM experiments WHERE state IN ('ACTIVE', 'UNSPECIFIED')")
def by_state(spark, folder):
    return _plain(ops.by_state(experiments(spark, folder), state_names=["active", "Unspecified"]))


@query("F4_page", f"WITH {EXPERIMENTS} SELECT {PLAIN} FROM experiments ORDER BY id LIMIT 100 OFFSET 250")
def page(spark, folder):
    return _plain(ops.page(experiments(spark, folder), limit=100, offset=250))


@query(
    "F5_experiment_class",
    f"""WITH {EXPERIMENTS} SELECT id, CASE state WHEN 'COMPLETED' THEN 'completed' WHEN 'ACTIVE' THEN 'active' END
          AS class FROM experiments""",
)
def experiment_class(spark, folder):
    return experiments(spark, folder).select("id", ops.experiment_class(F.col("state")).alias("class"))


@query(
    "F6_old_completed",
    f"""WITH {EXPERIMENTS} SELECT {PLAIN} FROM experiments
        WHERE state = 'COMPLETED' AND ended_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""",
)
def old_completed(spark, folder):
    return _plain(ops.old_completed(experiments(spark, folder), F.lit(AS_OF), 30))


@query("F8_one_by_id", f"WITH {EXPERIMENTS} SELECT {PLAIN} FROM experiments WHERE id = 77")
def one_by_id(spark, folder):
    return _plain(ops.one_by_id(experiments(spark, folder), 77))


@query(
    "F9_by_name_first",
    """SELECT c_mktsegment AS name, c_custkey AS id, c_name AS label FROM customer
       QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) = 1""",
)
def by_name_first(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("name"),
        F.col("c_custkey").alias("id"), F.col("c_name").alias("label"),
    )
    return ops.by_name_first(rows)


@query(
    "G7_missing_projects",
    """SELECT DISTINCT c_mktsegment AS workspace, CAST(c_nationkey AS VARCHAR) AS project FROM customer
       EXCEPT SELECT c_mktsegment, CAST(s_nationkey AS VARCHAR) FROM
         (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""",
)
def missing_projects(spark, folder):
    """Every segment has the projects of the suppliers with a large balance."""
    customers = table(spark, folder, "customer")
    configs = customers.select(F.col("c_mktsegment").alias("workspace"), F.col("c_nationkey").cast("string").alias("project"))
    kept = table(spark, folder, "supplier").where(F.col("s_acctbal") > 5000)
    present = configs.join(kept.select(F.col("s_nationkey").cast("string").alias("project")), "project", "left_semi")
    return ops.missing_projects(configs, present.distinct())


@query(
    "I4_submission_summary",
    """SELECT count(*) AS total, CAST(count_if(quality = 1 OR toxic = 1) AS BIGINT) AS succeeded,
              CAST(count_if(NOT (quality = 1 OR toxic = 1)) AS BIGINT) AS failed FROM labels""",
)
def submission_summary(spark, folder):
    success = F.expr("case when quality = 1 then 'True' when toxic = 1 then 'dry-run' else 'False' end")
    return ops.submission_summary(table(spark, folder, "labels").select(success.alias("success")))


@query(
    "K1_normalize_state",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'UNSPECIFIED'
         ELSE CASE o_orderstatus WHEN 'F' THEN 'ERROR' WHEN 'O' THEN 'STOPPING_KILLED' ELSE 'UNSPECIFIED' END END AS state
       FROM orders""",
)
def normalize_state(spark, folder):
    raw = F.expr(
        """concat(case o_orderkey % 4 when 0 then '' when 1 then 'STATE_' when 2 then 'STATE_STATE_' else 'x' end,
                  case o_orderstatus when 'F' then 'ERROR' when 'O' then 'STOPPING_KILLED' else 'error' end)"""
    )
    return table(spark, folder, "orders").select("o_orderkey", text.normalize_state(raw).alias("state"))


@query(
    "K2_parse_ts",
    """SELECT event_id, CASE event_id % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL
         WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 7200000000
         WHEN 3 THEN epoch_us(date_trunc('day', ts)) ELSE epoch_us(ts) END AS micros FROM events""",
)
def parse_ts(spark, folder):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    second = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kind = F.col("event_id") % 6
    raw = (
        F.when(kind == 0, F.concat(stamp, F.lit("Z")))
        .when(kind == 1, stamp)
        .when(kind == 2, F.concat(second, F.lit("+02:00")))
        .when(kind == 3, F.date_format("ts", "yyyy-MM-dd"))
        .when(kind == 4, F.concat(F.lit("at "), stamp))
        .otherwise(F.lit(""))
    )
    return table(spark, folder, "events").select("event_id", F.unix_micros(text.parse_ts(raw)).alias("micros"))


@query(
    "K3_iso_ts",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS stamp FROM events""",
)
def iso_ts(spark, folder):
    stamp = F.col("ts").cast("timestamp")
    cut = F.when(F.col("event_id") % 2 == 0, F.date_trunc("second", stamp)).otherwise(stamp)
    return table(spark, folder, "events").select("event_id", text.iso_ts(cut).alias("stamp"))


def _size_case(x: str) -> str:
    steps = " ".join(
        f"WHEN {x} / {float(1024**power)!r} < 1024 THEN format('{{:.2f}}', {x} / {float(1024**power)!r}) || ' {unit}'"
        for power, unit in enumerate(("B", "KB", "MB", "GB", "TB"))
    )
    return f"CASE {steps} ELSE format('{{:.2f}}', {x} / {float(1024**5)!r}) || ' PB' END"


@query(
    "K4_format_size",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {_size_case("size")} AS size_text
        FROM (SELECT *, l_extendedprice * pow(1024.0, l_orderkey % 6) / 8 AS size FROM lineitem)""",
)
def format_size(spark, folder):
    # a power of two, so exact; an eighth makes ties at the second decimal
    size = F.col("l_extendedprice") * F.pow(F.lit(1024.0), F.col("l_orderkey") % 6) / 8
    return table(spark, folder, "lineitem").select(
        "l_orderkey", long("l_linenumber").alias("l_linenumber"), text.format_size(size).alias("size_text")
    )


@query(
    "K5_format_duration",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE WHEN s < 60 THEN format('{:.1f}', s) || 's'
            WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ' || CAST(floor(s % 60) AS BIGINT) || 's'
            ELSE CAST(floor(s / 3600) AS BIGINT) || 'h ' || CAST(floor((s % 3600) / 60) AS BIGINT) || 'm '
                 || CAST(floor(s % 60) AS BIGINT) || 's' END AS duration_text
FROM (SELECT *, l_quantity * (CASE l_orderkey % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 17 ELSE 997 END)::DOUBLE AS s FROM lineitem)""",
)
def format_duration(spark, folder):
    factor = F.expr("double(case l_orderkey % 3 when 0 then 0.25 when 1 then 17 else 997 end)")
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        long("l_linenumber").alias("l_linenumber"),
        text.format_duration(F.col("l_quantity") * factor).alias("duration_text"),
    )


@query(
    "K7_path_parts",
    """SELECT page_id, name, CASE WHEN strpos(name[2:], '.') = 0 OR right(name, 1) = '.' THEN name
         ELSE left(name, length(name) - strpos(reverse(name), '.')) END AS stem
       FROM (SELECT page_id, split_part(url, '/', -1) AS name FROM pages)""",
)
def path_parts(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", text.path_name(F.col("url")).alias("name"), text.path_stem(F.col("url")).alias("stem")
    )


@query("K8_decode_names", "SELECT doc_id, text AS decoded FROM documents")
def decode_names(spark, folder):
    raw = F.encode("text", "UTF-8")
    return table(spark, folder, "documents").select("doc_id", text.decode_names(raw).alias("decoded"))


@query(
    "K9_experiment_report_line",
    f"""WITH {EXPERIMENTS} SELECT id, lpad(CAST(id AS VARCHAR), CAST(greatest(6, length(CAST(id AS VARCHAR))) AS INTEGER), ' ') || ' '
          || rpad(state, 15, ' ') || ' ' || rpad(owner, 15, ' ') || ' ' || name AS line FROM experiments""",
)
def experiment_report(spark, folder):
    return ops.experiment_report(experiments(spark, folder))


@query(
    "K9_submission_report_line",
    """SELECT CAST(doc_id AS VARCHAR) AS config, CASE WHEN quality = 1 THEN '[OK] ' ELSE '[FAIL] ' END || doc_id
         || CASE WHEN quality = 1 THEN ' -> ' || doc_id * 2 ELSE '' END
         || CASE WHEN toxic = 1 THEN chr(10) || '    refused' ELSE '' END AS line FROM labels""",
)
def submission_report(spark, folder):
    good = F.col("quality") == 1
    sent = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("config"),
        F.when(good, F.lit("True")).otherwise(F.lit("False")).alias("success"),
        F.when(good, (F.col("doc_id") * 2).cast("string")).alias("experiment_id"),
        F.when(F.col("toxic") == 1, F.lit("refused")).alias("error"),
    )
    return ops.submission_report(sent)


KINDS = """lines AS (
  SELECT CAST(conv_id AS VARCHAR) AS trial_id, conv_id, turn AS line_no, text,
    CASE WHEN (conv_id + turn) % 17 = 0 THEN 'error' WHEN (conv_id + turn) % 13 = 0 THEN 'broken'
         WHEN (conv_id + turn) % 11 = 0 THEN 'blank' WHEN (conv_id + turn) % 7 = 0 THEN 'nested'
         WHEN (conv_id + turn) % 5 = 0 THEN 'log' WHEN (conv_id + turn) % 3 = 0 THEN 'number'
         WHEN (conv_id + turn) % 19 = 0 THEN 'both' ELSE 'plain' END AS kind
  FROM conversations),
stops AS (SELECT trial_id, min(line_no) AS stop FROM lines WHERE kind = 'error' GROUP BY trial_id),
entries AS (
  SELECT l.trial_id, l.conv_id, l.line_no, CASE WHEN kind <> 'number' THEN text END AS message
  FROM lines l LEFT JOIN stops s ON s.trial_id = l.trial_id
  WHERE kind NOT IN ('error', 'broken', 'blank') AND (stop IS NULL OR line_no < stop))"""


def trial_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn as a log line of one of eight kinds."""
    place = F.col("conv_id") + F.col("turn")
    said = F.col("text")

    def result(entry, **more):
        return F.to_json(F.struct(entry.alias("result"), *[value.alias(name) for name, value in more.items()]))

    message = F.struct(said.alias("message"))
    line = (
        F.when(place % 17 == 0, F.lit('{"error": {"message": "gone"}}'))
        .when(place % 13 == 0, F.concat(F.lit('{"result": '), said))
        .when(place % 11 == 0, F.lit(""))
        .when(place % 7 == 0, result(F.struct(message.alias("message"))))
        .when(place % 5 == 0, result(F.struct(said.alias("log"))))
        .when(place % 3 == 0, result(F.struct(F.lit(5).alias("message"), said.alias("log"))))
        .when(place % 19 == 0, result(message, error=F.lit("late")))
        .otherwise(result(message))
    )
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("trial_id"), F.col("turn").alias("line_no"), line.alias("line")
    )


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return logs.trial_entries(trial_lines(spark, folder))


@query("A7_read_trial_logs", f"WITH {KINDS} SELECT trial_id, line_no FROM entries")
def read_trial_logs(spark, folder):
    return entries(spark, folder).select("trial_id", "line_no")


@query("K6_log_message", f"WITH {KINDS} SELECT trial_id, line_no, message FROM entries")
def log_message(spark, folder):
    return entries(spark, folder).select("trial_id", "line_no", logs.log_message("result").alias("message"))


@query(
    "H3_log_tail",
    f"""WITH {KINDS} SELECT trial_id, line_no FROM entries
        QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY line_no DESC) <= 3""",
)
def log_tail(spark, folder):
    return logs.log_tail(entries(spark, folder), 3).select("trial_id", "line_no")


@query(
    "H3_log_head",
    f"""WITH {KINDS} SELECT trial_id, line_no FROM entries
        QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY line_no) <= 3""",
)
def log_head(spark, folder):
    return logs.log_tail(entries(spark, folder), 3, "first").select("trial_id", "line_no")


TEXTS = """texts AS (
  SELECT trial_id, conv_id, string_agg(message, chr(10) ORDER BY line_no) AS text
  FROM (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY line_no) <= 100)
  GROUP BY trial_id, conv_id)"""


@query("I6_log_text", f"WITH {KINDS}, {TEXTS} SELECT trial_id, text FROM texts")
def log_text(spark, folder):
    return logs.log_text(entries(spark, folder))


@query(
    "G5_first_trial_logs",
    f"""WITH {KINDS}, {TEXTS}, firsts AS (
  SELECT conv_id % 20 AS experiment_id, min(conv_id) AS conv_id FROM conversations GROUP BY 1)
SELECT experiment_id, CAST(f.conv_id AS VARCHAR) AS trial_id, text
FROM firsts f LEFT JOIN texts t ON t.conv_id = f.conv_id""",
)
def first_trial_logs(spark, folder):
    trials = table(spark, folder, "conversations").select(
        (F.col("conv_id") % 20).alias("experiment_id"),
        F.col("conv_id").cast("string").alias("trial_id"),
        F.col("conv_id").alias("position"),
    )
    return logs.first_trial_logs(trials, entries(spark, folder))


@query(
    "A8_read_job_configs",
    """SELECT c_name AS path,
         CASE WHEN c_custkey % 7 = 6 THEN NULL WHEN c_custkey % 3 = 0 THEN 'default' ELSE c_mktsegment END AS workspace,
         CASE WHEN c_custkey % 7 = 6 OR c_custkey % 5 = 0 THEN NULL ELSE 'p' || c_nationkey END AS project,
         c_custkey % 7 <> 6 AS readable
       FROM customer""",
)
def read_job_configs(spark, folder):
    content = F.expr(
        r"""concat('name: "', c_name, '"\nlabels: [a, b]\nresources:\n  slots_per_trial: 1\n',
              case when c_custkey % 3 = 0 then '' else concat('workspace: ', c_mktsegment, '\n') end,
              case when c_custkey % 5 = 0 then 'project: ""\n' else concat('project: p', c_nationkey, '\n') end,
              case when c_custkey % 7 = 6 then 'broken: [1, 2' else '' end)"""
    )
    rows = table(spark, folder, "customer").select(F.col("c_name").alias("path"), content.alias("text"))
    return snapshots.job_configs(rows)


@query(
    "A9_project_manifest",
    """SELECT path, to_base64(encode(text)) AS content FROM (
         SELECT source || CASE doc_id % 6 WHEN 0 THEN '/.cache/' WHEN 1 THEN '/wandb/' WHEN 2 THEN '/__init__/'
                          WHEN 3 THEN '/a.b/.' ELSE '/' END || doc_id || '.txt' AS path, text, doc_id FROM documents)
       WHERE doc_id % 6 IN (2, 4, 5)""",
)
def project_manifest(spark, folder):
    path = F.expr(
        """concat(source, case doc_id % 6 when 0 then '/.cache/' when 1 then '/wandb/' when 2 then '/__init__/'
                          when 3 then '/a.b/.' else '/' end, doc_id, '.txt')"""
    )
    files = table(spark, folder, "documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    return projects.manifest(files)
