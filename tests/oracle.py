"""Compares queries with their SQL on the same tables; also a command: ``python tests/oracle.py sf_dir [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def kind(column: pa.ChunkedArray) -> str:
    for name in ("integer", "floating", "boolean"):
        if getattr(pa.types, f"is_{name}")(column.type):
            return name
    return "text" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else str(column.type)


def normal(table: pa.Table) -> pa.Table:
    return table.select(sorted(table.column_names)).sort_by([(name, "ascending") for name in sorted(table.column_names)])


def compare(found: pa.Table, wanted: pa.Table) -> str | None:
    """What differs, or none. Values must be equal, not just close."""
    if sorted(found.column_names) != sorted(wanted.column_names):
        return f"columns {sorted(found.column_names)} instead of {sorted(wanted.column_names)}"
    if found.num_rows != wanted.num_rows:
        return f"{found.num_rows} rows instead of {wanted.num_rows}"
    for name in found.column_names:
        if kind(found[name]) != kind(wanted[name]):
            return f"column {name} has type {found[name].type} instead of {wanted[name].type}"
    found, wanted = normal(found), normal(wanted)
    for name in found.column_names:
        a, b = found[name].to_pylist(), wanted[name].to_pylist()
        at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y and not (x != x and y != y)), None)
        if at is not None:
            return f"column {name} has {a[at]!r} instead of {b[at]!r} in {found.slice(at, 1).to_pylist()}"
    return None


def main(folder: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = connect(folder), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            found = queries[name](spark, folder).toArrow()
            spent = time.time() - start
            wanted = connection.execute(oracles[name]).to_arrow_table() if name in oracles else None
            problem = compare(found, wanted) if wanted is not None else "no SQL"
            rows = found.num_rows
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            problem, spent, rows = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start, 0
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={rows} {spent:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]) > 0)
