"""Positions, projections and windows over ``embeddings`` and ``events`` as recordings.

In ``embeddings`` the label is the file, ``vec_id`` the order and the embedding
the state. In ``events`` the user is the file, time the order, and the state
has the one value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaitworks.catalog.registry import as_matrix_rows, as_vector_rows, long, query, table
from gaitworks.functions import arrays
from gaitworks.operators import features, indexing, matrix
from gaitworks.sources.datasets import dataset_summary
from gaitworks.spec import RolloutSpec

# the embeddings are small numbers, so thresholds that part them
SPEC = RolloutSpec(joint_threshold=0.7, lin_threshold=0.25, ang_threshold=0.25)
VALUES = RolloutSpec(state_dim=1, cmd_dim=1)
CAP = 5000

STATES = """states AS (
  SELECT CAST(label AS BIGINT) AS file_idx, vec_id,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS sample_idx,
         count(*) OVER (PARTITION BY label) AS n, embedding AS state
  FROM embeddings)"""
EVENTS = """states AS (
  SELECT user_id AS file_idx, event_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
         count(*) OVER (PARTITION BY user_id) AS n, CAST(value AS FLOAT) AS x
  FROM events)"""
FILES = """files AS (
  SELECT file_idx, num_samples,
         CAST(coalesce(sum(num_samples) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS BIGINT) AS file_offset
  FROM (SELECT user_id AS file_idx, count(*) AS num_samples FROM events GROUP BY user_id))"""


def states(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(
        long("label").alias("file_idx"), "vec_id", F.col("embedding").alias("state")
    )
    return indexing.sample_index(rows, ["file_idx"], ["vec_id"])


def event_states(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("file_idx"), "ts", "event_id", F.array(F.col("value").cast("float")).alias("state")
    )
    return indexing.sample_index(rows, ["file_idx"], ["ts", "event_id"]).drop("ts")


def event_files(spark: SparkSession, folder: str) -> DataFrame:
    """Positions are not needed to count, so only the user column is read."""
    users = table(spark, folder, "events").select(F.col("user_id").alias("file_idx"))
    return indexing.with_offsets(indexing.file_counts(users))


def with_action(samples: DataFrame) -> DataFrame:
    """An action of 20 steps and 31 dims cut from the state: ``action[s][d] = state[s + d]``."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda start: F.slice("state", start, 31))
    return samples.withColumn("action", steps)


@query(
    "E5_sample_index",
    f"WITH {STATES} SELECT file_idx, vec_id, sample_idx FROM states",
)
def sample_index(spark, folder):
    return states(spark, folder).select("file_idx", "vec_id", "sample_idx")


@query("E5_sample_index_events", f"WITH {EVENTS} SELECT file_idx, event_id, sample_idx FROM states")
def sample_index_events(spark, folder):
    return event_states(spark, folder).select("file_idx", "event_id", "sample_idx")


@query(
    "D1_to_float32",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(d AS BIGINT) AS dim,
              CAST(CAST(v AS FLOAT) AS DOUBLE) AS value
       FROM (SELECT l_orderkey, l_linenumber, unnest([0, 1, 2, 3]) AS d,
                    unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)""",
)
def to_float32(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey",
        long("l_linenumber").alias("l_linenumber"),
        arrays.to_float32(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("v"),
    )
    return as_vector_rows(rows, "v", ("l_orderkey", "l_linenumber"))


def _leading(width: int) -> str:
    return f"""WITH {STATES}
SELECT file_idx, sample_idx, CAST(d AS BIGINT) AS dim, CAST(state[d + 1] AS DOUBLE) AS value
FROM (SELECT *, unnest(range({width})) AS d FROM states)"""


@query("D2_trim_state", _leading(60))
def trim_state(spark, folder):
    rows = states(spark, folder).withColumn("state", arrays.trim_state("state", 60))
    return as_vector_rows(rows, "state")


@query("D3_cmd", _leading(58))
def command(spark, folder):
    return as_vector_rows(features.derive(states(spark, folder), SPEC, ["cmd"]), "cmd")


@query(
    "D4_trim_action",
    f"""WITH {STATES}
SELECT file_idx, sample_idx, CAST(s AS BIGINT) AS step, CAST(d AS BIGINT) AS dim,
       CAST(state[s + d + 1] AS DOUBLE) AS value
FROM (SELECT *, unnest(range(29)) AS d FROM (SELECT *, unnest(range(16)) AS s FROM states))""",
)
def trim_action(spark, folder):
    rows = features.derive(with_action(states(spark, folder)), SPEC, [])
    return as_matrix_rows(rows, "action")


NORMS = """norms AS (
  SELECT file_idx, sample_idx,
    CAST(sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN state[30:58]])) AS FLOAT) AS joint_vel_norm,
    CAST(sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN state[59:61]])) AS FLOAT) AS base_lin_norm,
    CAST(sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) FOR v IN state[62:64]])) AS FLOAT) AS base_ang_norm
  FROM states)"""
FLAG = """CASE WHEN (NOT isnan(base_ang_norm) AND base_ang_norm > CAST(0.25 AS FLOAT))
       OR (NOT isnan(joint_vel_norm) AND joint_vel_norm > CAST(0.7 AS FLOAT))
       OR (NOT isnan(base_lin_norm) AND base_lin_norm > CAST(0.25 AS FLOAT)) THEN 1.0 ELSE 0.0 END"""


@query(
    "D5_segment_norms",
    f"""WITH {STATES}, {NORMS}
SELECT file_idx, sample_idx, round(CAST(joint_vel_norm AS DOUBLE), 5) AS joint_vel_norm,
       round(CAST(base_lin_norm AS DOUBLE), 5) AS base_lin_norm,
       round(CAST(base_ang_norm AS DOUBLE), 5) AS base_ang_norm
FROM norms""",
)
def segment_norms(spark, folder):
    norms = arrays.segment_norms("state", SPEC)
    rounded = [F.round(norm.cast("double"), 5).alias(name) for name, norm in norms.items()]
    return states(spark, folder).select("file_idx", "sample_idx", *rounded)


@query(
    "D6_recovery_flag",
    f"WITH {STATES}, {NORMS} SELECT file_idx, sample_idx, CAST({FLAG} AS DOUBLE) AS recovery_flag FROM norms",
)
def recovery_flag(spark, folder):
    rows = features.derive(states(spark, folder), SPEC, ["recovery_flag"])
    return rows.select("file_idx", "sample_idx", F.col("recovery_flag").cast("double").alias("recovery_flag"))


@query(
    "D7_elementwise_delta",
    f"""WITH {STATES}
SELECT file_idx, sample_idx, CAST(d AS BIGINT) AS dim, CAST(state[64 - d] - state[d + 1] AS DOUBLE) AS value
FROM (SELECT *, unnest(range(64)) AS d FROM states)""",
)
def elementwise_delta(spark, folder):
    delta = arrays.elementwise_delta(F.reverse("state"), F.col("state")).alias("delta")
    return as_vector_rows(states(spark, folder).select("file_idx", "sample_idx", delta), "delta")


def _history(width: int) -> str:
    return f"""WITH {STATES}, pairs AS (
  SELECT file_idx, sample_idx, s AS step, greatest(sample_idx - 2 + s, 0) AS at
  FROM (SELECT *, unnest(range(3)) AS s FROM states))
SELECT p.file_idx, p.sample_idx, CAST(p.step AS BIGINT) AS step, CAST(d AS BIGINT) AS dim,
       CAST(state[d + 1] AS DOUBLE) AS value
FROM (SELECT p.*, q.state, unnest(range({width})) AS d
      FROM pairs p JOIN states q ON q.file_idx = p.file_idx AND q.sample_idx = p.at) p"""


@query("E1_state_hist", _history(64))
def state_hist(spark, folder):
    return as_matrix_rows(features.derive(states(spark, folder), SPEC, ["state_hist"]), "state_hist")


@query("E2_cmd_hist", _history(58))
def cmd_hist(spark, folder):
    return as_matrix_rows(features.derive(states(spark, folder), SPEC, ["cmd_hist"]), "cmd_hist")


DELTA = f"""WITH {STATES}, pairs AS (
  SELECT file_idx, sample_idx, state AS base, s AS step, least(sample_idx + s + 1, n - 1) AS at
  FROM (SELECT *, unnest(range(16)) AS s FROM states))
SELECT file_idx, sample_idx, CAST(step AS BIGINT) AS step, CAST(d AS BIGINT) AS dim,
       CAST(state[d + 1] - base[d + 1] AS DOUBLE) AS value
FROM (SELECT p.file_idx, p.sample_idx, p.step, p.base, q.state, unnest(range(64)) AS d
      FROM pairs p JOIN states q ON q.file_idx = p.file_idx AND q.sample_idx = p.at)"""


@query("E3_state_delta", DELTA)
def state_delta(spark, folder):
    return as_matrix_rows(features.derive(states(spark, folder), SPEC, ["state_delta"]), "state_delta")


@query("E3_state_delta_small_blocks", DELTA)
def state_delta_small_blocks(spark, folder):
    """The same cut into blocks of 8 rows, which puts block ends inside every file."""
    rows = features.derive(states(spark, folder), SPEC, ["state_delta"], block_rows=8)
    return as_matrix_rows(rows, "state_delta")


EVENT_HISTORY = f"""WITH {EVENTS}
SELECT p.file_idx, p.event_id, CAST(p.s AS BIGINT) AS step, CAST(q.x AS DOUBLE) AS value
FROM (SELECT *, unnest(range(3)) AS s FROM states) p
JOIN states q ON q.file_idx = p.file_idx AND q.sample_idx = greatest(p.sample_idx - 2 + p.s, 0)"""
EVENT_DELTA = f"""WITH {EVENTS}
SELECT p.file_idx, p.event_id, CAST(p.s AS BIGINT) AS step, CAST(q.x - p.x AS DOUBLE) AS value
FROM (SELECT *, unnest(range(16)) AS s FROM states) p
JOIN states q ON q.file_idx = p.file_idx AND q.sample_idx = least(p.sample_idx + p.s + 1, p.n - 1)"""


@query("E1_state_hist_events", EVENT_HISTORY)
def state_hist_events(spark, folder):
    rows = features.derive(event_states(spark, folder), VALUES, ["state_hist"])
    return as_matrix_rows(rows, "state_hist", ("file_idx", "event_id")).drop("dim")


@query("E3_state_delta_events", EVENT_DELTA)
def state_delta_events(spark, folder):
    rows = features.derive(event_states(spark, folder), VALUES, ["state_delta"])
    return as_matrix_rows(rows, "state_delta", ("file_idx", "event_id")).drop("dim")


@query("E4_file_offsets", f"WITH {FILES} SELECT file_idx, num_samples, file_offset FROM files")
def file_offsets(spark, folder):
    return event_files(spark, folder)


@query(
    "E6_file_ranges",
    f"""WITH {FILES}, ends AS (
  SELECT file_idx, file_offset AS start,
         least(lead(file_offset, 1, (SELECT sum(num_samples) FROM files)) OVER (ORDER BY file_idx), {CAP}) AS "end"
  FROM files)
SELECT file_idx, start, CAST("end" AS BIGINT) AS "end", CAST("end" - start AS BIGINT) AS num_samples,
       CAST(coalesce(sum("end" - start) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS out_offset
FROM ends WHERE "end" > start""",
)
def file_ranges(spark, folder):
    files = event_files(spark, folder)
    total = indexing.total_samples(files).first()[0]
    return indexing.file_ranges(files.drop("num_samples"), total, CAP)


@query(
    "E6_file_ranges_gaps",
    f"""WITH {FILES}, kept AS (SELECT * FROM files WHERE file_idx % 3 <> 1)
SELECT file_idx, CAST(file_offset AS BIGINT) AS start, CAST(file_offset + num_samples AS BIGINT) AS "end",
       CAST(num_samples AS BIGINT) AS num_samples,
       CAST(coalesce(sum(num_samples) OVER (ORDER BY file_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS out_offset
FROM kept WHERE num_samples > 0""",
)
def file_ranges_gaps(spark, folder):
    """A third of the indices is absent; ends come from the declared counts."""
    files = event_files(spark, folder)
    total = indexing.total_samples(files).first()[0]
    return indexing.file_ranges(files.where(F.col("file_idx") % 3 != 1), total)


@query(
    "F1_cap_samples",
    f"""WITH {FILES}, {EVENTS}, kept AS (
  SELECT s.file_idx, s.event_id, s.sample_idx, s.x, count(*) OVER (PARTITION BY s.file_idx) AS n
  FROM states s JOIN files f ON f.file_idx = s.file_idx WHERE f.file_offset + s.sample_idx < {CAP})
SELECT p.file_idx, p.event_id, CAST(p.s AS BIGINT) AS step, CAST(q.x - p.x AS DOUBLE) AS value
FROM (SELECT *, unnest(range(16)) AS s FROM kept) p
JOIN kept q ON q.file_idx = p.file_idx AND q.sample_idx = least(p.sample_idx + p.s + 1, p.n - 1)""",
)
def cap_samples(spark, folder):
    """The first rows over all files, then the look-ahead: its end moves to the cap."""
    capped = indexing.cap_samples(event_states(spark, folder), event_files(spark, folder), CAP)
    rows = features.derive(capped, VALUES, ["state_delta"])
    return as_matrix_rows(rows, "state_delta", ("file_idx", "event_id")).drop("dim")


@query("F2_cap_files", f"WITH {FILES} SELECT file_idx, num_samples FROM files WHERE file_idx < 40")
def cap_files(spark, folder):
    return indexing.cap_files(event_files(spark, folder), 40).select("file_idx", "num_samples")


@query(
    "G3_locate_sample",
    f"""WITH {FILES}
SELECT l_orderkey AS global_row, CAST(l_linenumber AS BIGINT) AS l_linenumber, file_idx,
       l_orderkey - file_offset AS sample_idx
FROM lineitem JOIN files ON l_orderkey >= file_offset AND l_orderkey < file_offset + num_samples""",
)
def locate_sample(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("global_row"), long("l_linenumber").alias("l_linenumber")
    )
    return indexing.locate_samples(rows, event_files(spark, folder))


@query(
    "G4_attach_offset",
    f"""WITH {FILES}, {EVENTS}
SELECT s.file_idx, s.event_id, s.sample_idx, f.file_offset + s.sample_idx AS global_row
FROM states s JOIN files f ON f.file_idx = s.file_idx""",
)
def attach_offset(spark, folder):
    rows = event_states(spark, folder).select("file_idx", "event_id", "sample_idx")
    return indexing.attach_offset(rows, event_files(spark, folder))


@query("I5_total_samples", "SELECT count(*) AS total_samples FROM events")
def total_samples(spark, folder):
    return indexing.total_samples(event_files(spark, folder))


def _shape(name: str, smallest: str, largest: str) -> str:
    return f"SELECT '{name}' AS field, n AS num_samples, {smallest} AS min_shape, {largest} AS max_shape FROM w"


@query(
    "I9_dataset_summary",
    "WITH w AS (SELECT count(*) AS n, min(len(embedding)) AS a, max(len(embedding)) AS b FROM embeddings) "
    + " UNION ALL ".join(
        [
            _shape("state", "CAST(a AS VARCHAR)", "CAST(b AS VARCHAR)"),
            _shape("cmd", "'58'", "'58'"),
            _shape("state_hist", "'3,' || a", "'3,' || b"),
            _shape("cmd_hist", "'3,58'", "'3,58'"),
            _shape("state_delta", "'16,' || a", "'16,' || b"),
        ]
    ),
)
def summary(spark, folder):
    found = dataset_summary(features.derive(states(spark, folder), SPEC))
    text = [F.concat_ws(",", F.col(name).cast("array<string>")).alias(name) for name in ("min_shape", "max_shape")]
    return found.select("field", "num_samples", *text)


ALL = f"""WITH {STATES}, {NORMS}, wide AS (
  SELECT p.file_idx, p.sample_idx, p.k, least(p.sample_idx + p.k + 1, p.n - 1) AS ahead,
         greatest(p.sample_idx - p.k, 0) AS back, p.state
  FROM (SELECT *, unnest(range(16)) AS k FROM states) p)
SELECT w.file_idx, w.sample_idx, CAST(w.k AS BIGINT) AS k, CAST(n.flag AS DOUBLE) AS recovery_flag,
       CAST(a.state[1 + w.k] - w.state[1 + w.k] AS DOUBLE) AS ahead_delta,
       CASE WHEN w.k < 3 THEN CAST(b.state[64 - w.k] AS DOUBLE) END AS past_value,
       CAST(w.state[58 - w.k] AS DOUBLE) AS cmd_value
FROM wide w
JOIN states a ON a.file_idx = w.file_idx AND a.sample_idx = w.ahead
JOIN states b ON b.file_idx = w.file_idx AND b.sample_idx = w.back
JOIN (SELECT *, {FLAG} AS flag FROM norms) n ON n.file_idx = w.file_idx AND n.sample_idx = w.sample_idx"""


@query("rollout_features", ALL)
def rollout_features(spark, folder):
    """All features of every sample, read back along a diagonal: step k at dim k."""
    rows = features.derive(states(spark, folder), SPEC)

    def cell(k):
        back = F.get(F.get("state_hist", F.lit(SPEC.cond_steps - 1) - k), F.lit(63) - k)
        return F.struct(
            k.cast("long").alias("k"),
            F.get(F.get("state_delta", k), k).cast("double").alias("ahead_delta"),
            F.when(k < SPEC.cond_steps, back.cast("double")).alias("past_value"),
            F.get("cmd", F.lit(57) - k).cast("double").alias("cmd_value"),
        )

    steps = F.transform(F.sequence(F.lit(0), F.lit(SPEC.horizon_steps - 1)), cell)
    flag = F.col("recovery_flag").cast("double").alias("recovery_flag")
    return rows.select("file_idx", "sample_idx", flag, F.inline(steps))


_WHOLE = {
    "state_hist": ("step", _history(64)),
    "cmd_hist": ("step", _history(58)),
    "state_delta": ("step", DELTA),
    "cmd": ("CAST(0 AS BIGINT)", _leading(58)),
    "recovery_flag": (
        "CAST(0 AS BIGINT)",
        f"WITH {STATES}, {NORMS} SELECT file_idx, sample_idx, CAST(0 AS BIGINT) AS dim, CAST({FLAG} AS DOUBLE) AS value FROM norms",
    ),
}


@query(
    "rollout_features_cells",
    " UNION ALL ".join(
        f"SELECT '{name}' AS field, file_idx, sample_idx, {step} AS step, dim, value FROM ({sql})" for name, (step, sql) in _WHOLE.items()
    ),
)
def rollout_features_cells(spark, folder):
    """Every cell of every feature, from one ``derive``."""
    rows = features.derive(states(spark, folder), SPEC)

    def cells(name, matrix):
        def cell(row, step):
            return F.transform(
                row,
                lambda value, dim: F.struct(
                    F.lit(name).alias("field"), step.cast("long").alias("step"), dim.cast("long").alias("dim"), value.cast("double").alias("value")
                ),
            )

        return F.flatten(F.transform(matrix, cell))

    shapes = {
        **{name: F.col(name) for name in ("state_hist", "cmd_hist", "state_delta")},
        "cmd": F.array("cmd"),
        "recovery_flag": F.array(F.array("recovery_flag")),
    }
    return rows.select("file_idx", "sample_idx", F.inline(F.concat(*[cells(name, matrix) for name, matrix in shapes.items()])))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        long("label").alias("label"), "vec_id", F.posexplode("embedding").alias("dim", "v")
    )


GRAM = """WITH cells AS (
  SELECT CAST(label AS BIGINT) AS label, vec_id, d, CAST(embedding[d + 1] AS DOUBLE) AS v
  FROM (SELECT *, unnest(range(64)) AS d FROM embeddings)),
product AS (
  SELECT a.label * 64 + a.d AS i, b.d AS j, sum(a.v * b.v) AS v
  FROM cells a JOIN cells b ON a.vec_id = b.vec_id GROUP BY 1, 2)"""


def gram(spark: SparkSession, folder: str) -> DataFrame:
    """The Gram matrix of each label's states, all labels in one product."""
    cells = _cells(spark, folder)
    left = cells.select((F.col("label") * 64 + F.col("dim")).alias("i"), F.col("vec_id").alias("k"), "v")
    right = cells.select(F.col("vec_id").alias("k"), long("dim").alias("j"), "v")
    return matrix.matrix_product(left, right)


@query("I7_matrix_product", f"{GRAM} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 6) AS v FROM product")
def matrix_product(spark, folder):
    return gram(spark, folder).select("i", "j", F.round("v", 6).alias("v"))


@query("I8_checksum", f"{GRAM} SELECT round(sum(v), 5) AS checksum FROM product")
def checksum(spark, folder):
    return matrix.checksum(gram(spark, folder)).select(F.round("checksum", 5).alias("checksum"))
