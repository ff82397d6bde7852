"""History windows, look-ahead differences and the instability flag.

All windows run over one file in sample order. Files are cut into blocks of
``block_rows`` samples; the rows near a block's ends are copied to the
neighbouring block, so that a window never needs more than its own block. One
shuffle on (file, block) and one sort serve every feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.functions import arrays
from gaitworks.operators.joins import join_lookup
from gaitworks.spec import RolloutSpec

BLOCK_ROWS = 4096
# of shuffled input per task on large data; the sort spills beyond memory
PARTITION_BYTES = 512 << 20
# tasks per core on small data, so that uneven hashing of blocks evens out
TASKS_PER_CORE = 4
FEATURES = ("cmd", "state_hist", "cmd_hist", "state_delta", "recovery_flag")
FRAME, PLACE, BLOCK, RUN = "_frame", "_place", "_block", "_run"


def with_frame(
    samples: DataFrame,
    back: int,
    ahead: int,
    value: str = "state",
    block_rows: int = BLOCK_ROWS,
    offsets: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Adds the values of rows t-back..t+ahead (as far as the file goes) and row t's place among them.

    Needs dense ``sample_idx`` from 0 within ``file_idx``; a null value, which
    a list of rows would silently skip, is an error.
    Copies carry only the keys and the value, so wide columns such as actions
    are shuffled once. That shuffle is always by file and block: input that is
    partitioned by file alone would satisfy the window too, but would leave a
    huge file to one task. Without ``partitions`` the session's number is
    taken, and coalesced at run time.

    With ``offsets`` (``file_idx, file_offset, num_samples``) the rows come in
    file and sample order over all partitions: each partition gets a run of
    blocks by their place over all files, which needs no sampling pass.
    """
    index = F.col("sample_idx")
    home = F.call_function("div", index, F.lit(block_rows))
    first = F.call_function("div", F.greatest(index - ahead, F.lit(0)), F.lit(block_rows))
    last = F.call_function("div", index + back, F.lit(block_rows))
    spread = samples.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    at_home = F.col(BLOCK) == home
    keys = ("file_idx", "sample_idx", value)
    rest = [F.when(at_home, F.col(name)).alias(name) for name in samples.columns if name not in keys]
    present = F.coalesce(value, F.raise_error(F.lit(f"null {value}"))).alias(value)
    lean = spread.select("file_idx", "sample_idx", present, BLOCK, *rest)
    blocks = ["file_idx", BLOCK]
    if offsets is None:
        lean = lean.repartition(*([] if partitions is None else [partitions]), *blocks)
    else:
        lean = _in_runs(lean, offsets, partitions, block_rows)
        # the run leads the keys, so that its partitioning and order are the window's own
        blocks = [RUN, *blocks]
    within = Window.partitionBy(*blocks).orderBy("sample_idx")
    framed = lean.select(
        "*",
        F.collect_list(value).over(within.rowsBetween(-back, ahead)).alias(FRAME),
        (F.row_number().over(within) - 1).alias("_row"),
    )
    return (
        framed.where(at_home)
        .withColumn(PLACE, F.least(F.col("_row"), F.lit(back)))
        .select(*samples.columns, FRAME, PLACE)
    )


def _in_runs(lean: DataFrame, offsets: DataFrame, partitions: int | None, block_rows: int) -> DataFrame:
    """Rows dealt to partitions by the place of their block over all files."""
    total = offsets.agg(F.coalesce(F.sum("num_samples"), F.lit(0))).first()[0]
    number = partitions or int(lean.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, math.ceil(total / number))
    placed = join_lookup(lean, offsets.select("file_idx", "file_offset"), ["file_idx"], F.col("sample_idx"))
    run = F.call_function("div", F.col("file_offset") + F.col(BLOCK) * block_rows, F.lit(share))
    # copies behind a file's end may point beyond the last run; they are dropped after the window
    return placed.withColumn(RUN, F.least(run, F.lit(number - 1)).cast("int")).repartitionById(number, RUN)


def history(steps: int) -> Column:
    """Rows t-steps+1..t, oldest first; before the start the file's first row repeats."""
    seen = F.slice(FRAME, 1, F.col(PLACE) + 1)
    missing = F.lit(steps - 1) - F.col(PLACE)
    return F.concat(F.array_repeat(F.get(FRAME, F.lit(0)), missing), seen)


def future(steps: int) -> Column:
    """Rows t+1..t+steps; past the end the file's last row repeats."""
    length = F.size(FRAME)
    seen = F.slice(FRAME, F.col(PLACE) + 2, steps)
    missing = F.lit(steps + 1) + F.col(PLACE) - length
    return F.concat(seen, F.array_repeat(F.get(FRAME, length - 1), missing))


def window_partitions(rows: int, spec: RolloutSpec, cores: int, block_rows: int = BLOCK_ROWS) -> int:
    """Partitions for the windows over so many samples: by bytes, or on small data by cores and blocks."""
    row_bytes = 4 * (spec.state_dim + spec.horizon_steps * spec.action_dim)
    by_size = math.ceil(rows * row_bytes / PARTITION_BYTES)
    return max(1, by_size, min(TASKS_PER_CORE * cores, math.ceil(rows / block_rows)))


def needs_window(features: Sequence[str]) -> bool:
    return bool({"state_hist", "cmd_hist", "state_delta"} & set(features))


def derive(
    samples: DataFrame,
    spec: RolloutSpec = RolloutSpec(),
    features: Sequence[str] = FEATURES,
    block_rows: int = BLOCK_ROWS,
    offsets: DataFrame | None = None,
    partitions: int | None = None,
    trimmed_action: bool = False,
) -> DataFrame:
    """The chosen features beside the trimmed state (and action, where there is one).

    A feature that needs no window causes no shuffle; ``offsets`` puts the rows in order (see ``with_frame``). ``trimmed_action`` says
    that the reader has cut the action already.
    """
    unknown = [name for name in features if name not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features {unknown}; known are {list(FEATURES)}")
    columns = [name for name in samples.columns if name not in ("state", "action")]
    state = arrays.trim_state(arrays.to_float32("state"), spec.state_dim).alias("state")
    action = []
    if "action" in samples.columns:
        whole = arrays.to_float32("action", 2)
        if not trimmed_action:
            whole = arrays.trim_action(whole, spec.horizon_steps, spec.action_dim)
        action = [whole.alias("action")]
    trimmed = samples.select(*columns, *action, state)

    back = spec.cond_steps - 1 if {"state_hist", "cmd_hist"} & set(features) else 0
    ahead = spec.horizon_steps if "state_delta" in features else 0
    if needs_window(features):
        trimmed = with_frame(trimmed, back, ahead, block_rows=block_rows, offsets=offsets, partitions=partitions)

    def commands(frames: Column) -> Column:
        return F.transform(frames, lambda row: arrays.command(row, spec.cmd_dim))

    def deltas(frames: Column) -> Column:
        return F.transform(frames, lambda row: arrays.elementwise_delta(row, F.col("state")))

    built = {
        "cmd": lambda: arrays.command("state", spec.cmd_dim),
        "state_hist": lambda: history(spec.cond_steps),
        "cmd_hist": lambda: commands(history(spec.cond_steps)),
        "state_delta": lambda: deltas(future(spec.horizon_steps)),
        "recovery_flag": lambda: arrays.recovery_flag("state", spec),
    }
    kept = [name for name in trimmed.columns if name not in (FRAME, PLACE)]
    return trimmed.select(*kept, *[built[name]().alias(name) for name in features])
