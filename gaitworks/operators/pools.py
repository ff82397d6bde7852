"""Slots and pools of a cluster snapshot: use, availability and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.functions.text import pool_report_line


def slot_is_available() -> Column:
    return F.col("enabled") & F.col("container_id").isNull()


def pool_counts(slots: DataFrame) -> DataFrame:
    """``name, total_slots, used_slots`` per pool; summed before the shuffle, so a giant pool is no hot key."""
    return (
        slots.where(F.col("resource_pool").isNotNull())
        .groupBy(F.col("resource_pool").alias("name"))
        .agg(
            F.count("*").cast("int").alias("total_slots"),
            F.count_if(~slot_is_available()).cast("int").alias("used_slots"),
        )
    )


def utilization(used: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(used / total)


def pool_slots(pools: DataFrame, slots: DataFrame) -> DataFrame:
    """Pools with total, used and available slots and utilization; a pool without slots has zeros."""
    joined = pools.join(pool_counts(slots), "name", "left")
    total = F.coalesce("total_slots", F.lit(0))
    used = F.coalesce("used_slots", F.lit(0))
    return joined.select(
        *pools.columns,
        total.alias("total_slots"),
        used.alias("used_slots"),
        (total - used).alias("available_slots"),
        utilization(used, total).alias("utilization_rate"),
    )


def pool_stats(pool_rows: DataFrame, position: str = "position") -> DataFrame:
    """One row per name; of equal names the last counts."""
    columns = [name for name in pool_rows.columns if name not in ("name", position)]
    last = F.max_by(F.struct(*columns), position).alias("_last")
    return pool_rows.groupBy("name").agg(last).select("name", "_last.*")


def avoid_pools(pools: DataFrame, avoided: DataFrame | Sequence[str]) -> DataFrame:
    """Pools whose name is not in the avoided set, which is a table or a list."""
    if isinstance(avoided, DataFrame):
        return pools.join(avoided.select("name").distinct(), "name", "left_anti")
    return pools.where(~F.col("name").isin(*avoided)) if avoided else pools


def available_pools(
    pools: DataFrame, avoided: DataFrame | Sequence[str] = (), min_free_slots: int = 1
) -> DataFrame:
    return avoid_pools(pools, avoided).where(F.col("available_slots") >= min_free_slots)


def ranking(prefer: Sequence[str] = ()) -> list[Column]:
    """Sort keys: place in the preference list (others after it), free slots downwards, name."""
    names = F.array(*[F.lit(name) for name in prefer]) if prefer else F.array().cast("array<string>")
    place = F.coalesce(F.nullif(F.array_position(names, F.col("name")), F.lit(0)) - 1, F.lit(len(prefer)))
    return [place, F.col("available_slots").desc(), F.col("name")]


def rank_pools(
    pools: DataFrame,
    avoided: DataFrame | Sequence[str] = (),
    min_free_slots: int = 1,
    prefer: Sequence[str] = (),
    max_pools: int | None = None,
) -> DataFrame:
    """Available pools, best first; no number or 0 means all."""
    ranked = available_pools(pools, avoided, min_free_slots).orderBy(*ranking(prefer))
    return ranked.limit(max_pools) if max_pools else ranked


def best_pool(
    pools: DataFrame,
    required_slots: int = 1,
    prefer: Sequence[str] = (),
    avoided: DataFrame | Sequence[str] = (),
    min_free_slots: int = 1,
) -> DataFrame:
    """The first of the ranking with enough free slots; no row when there is none."""
    return rank_pools(pools, avoided, max(required_slots, min_free_slots), prefer, max_pools=1)


def list_pools(
    pools: DataFrame,
    available_only: bool = False,
    min_free_slots: int = 0,
    prefer: Sequence[str] = (),
    avoided: DataFrame | Sequence[str] = (),
) -> DataFrame:
    """The report's pools: ranked and filtered when only available ones are asked for, else all as they are."""
    return rank_pools(pools, avoided, min_free_slots, prefer) if available_only else pools


def pool_report(pools: DataFrame) -> DataFrame:
    line = pool_report_line(
        F.col("name"), F.col("available_slots"), F.col("total_slots"), F.col("utilization_rate")
    )
    return pools.select("name", line.alias("line"))
