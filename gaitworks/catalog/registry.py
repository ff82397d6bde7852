"""Where queries and their SQL are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enter a function of (session, folder of tables) under a name."""

    def enter(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return enter


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_vector_rows(df: DataFrame, column: str, keys: tuple[str, ...] = ("file_idx", "sample_idx")) -> DataFrame:
    """One row per element of an array column, as ``dim, value``."""
    return df.select(*keys, F.posexplode(column).alias("dim", "value")).select(
        *keys, F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value")
    )


def as_matrix_rows(df: DataFrame, column: str, keys: tuple[str, ...] = ("file_idx", "sample_idx")) -> DataFrame:
    """One row per element of an array of arrays, as ``step, dim, value``."""
    steps = df.select(*keys, F.posexplode(column).alias("step", "_row"))
    return as_vector_rows(steps.withColumn("step", F.col("step").cast("long")), "_row", (*keys, "step"))


def long(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")
