"""Filters, paging and reports over experiment snapshots, and submission results."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitworks.functions.text import experiment_report_line

# The classes of experiment states.
FAILED = ("ERROR", "CANCELED", "DELETE_FAILED")
COMPLETED = ("COMPLETED",)
ACTIVE = ("ACTIVE", "RUNNING", "STARTING", "PULLING", "QUEUE")

#: Rows among which a page is found by sorting; the rest is only counted.
SORTED_ROWS = 200_000
#: Rows that cut the range still looked through, in each round of counting.
PIVOTS = 32


def by_state(
    experiments: DataFrame, states: Sequence[str] = (), state_names: Sequence[str] = ()
) -> DataFrame:
    """Experiments in the given states; ``states`` wins over names, which are upper-cased; none keeps all."""
    wanted = list(states) or [name.upper() for name in state_names]
    return experiments.where(F.col("state").isin(*wanted)) if wanted else experiments


def page(
    df: DataFrame,
    order: Sequence[str] = ("id",),
    limit: int = 100,
    offset: int = 0,
    sorted_rows: int = SORTED_ROWS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """Rows offset..offset+limit in the given order, nulls first.

    All other columns that can be ordered break ties, so that pages do not
    overlap. However deep the page, the table is neither sorted nor copied: rows
    that are drawn at random cut it into ranges, the ranges are counted, and
    the one in which the page starts is cut again, until it has at most
    ``sorted_rows`` rows; so many, and the page, are all that is sorted. The
    table is read once a round, of which there are a few, so it should give
    the same rows each time.
    """
    keys = {f"_key{i}": _sortable(df, name) for i, name in enumerate([*order, *[n for n in df.columns if n not in order]])}
    keys = {name: key for name, key in keys.items() if key is not None}
    names = list(keys)
    keyed = df.select("*", F.struct(*[key.alias(name) for name, key in keys.items()]).alias("_key"))
    least: Column | None = None  # rows from here on count, all of which lie behind so many others
    before, rows = 0, keyed.count()
    inside = keyed
    while rows > sorted_rows and before + rows > offset:
        drawn = inside.orderBy(F.rand(before + rows)).limit(pivots).select("_key.*")
        cuts = [_literal(row, drawn) for row in drawn.distinct().orderBy(*names).collect()]
        # ranges between pivots have even numbers, the rows equal to a pivot odd ones
        place: Column | None = None
        for number, cut in reversed(list(enumerate(cuts))):
            for holds, value in ((F.col("_key") > cut, 2 * number + 2), (F.col("_key") == cut, 2 * number + 1)):
                place = F.when(holds, F.lit(value)) if place is None else place.when(holds, F.lit(value))
        place = place.otherwise(F.lit(0))
        counts = {row["_place"]: row["count"] for row in inside.groupBy(place.alias("_place")).count().collect()}
        for number in range(2 * len(cuts) + 1):
            found = counts.get(number, 0)
            if before + found > offset:
                break
            before += found
        cut = cuts[(number - 1) // 2] if number else None
        if number % 2:
            # equal rows: any of them will do for the page
            same = keyed.where(F.col("_key") == cut).limit(min(limit, before + found - offset))
            rest = limit - (before + found - offset)
            behind = keyed.where(F.col("_key") > cut).orderBy("_key").limit(max(rest, 0))
            return same.unionByName(behind).orderBy("_key").select(*df.columns)
        inside = inside if cut is None else inside.where(F.col("_key") > cut)
        least = least if cut is None else F.col("_key") > cut
        inside = inside.where(F.col("_key") < cuts[number // 2]) if number // 2 < len(cuts) else inside
        rows = found
    if before + rows <= offset:
        return df.limit(0)
    candidates = keyed if least is None else keyed.where(least)
    return candidates.orderBy("_key").offset(offset - before).limit(limit).select(*df.columns)


def _sortable(df: DataFrame, name: str) -> Column | None:
    """A column as a value that sorts alike and survives the way through the driver; none if it has no order."""
    kind, column = df.schema[name].dataType, F.col("`" + name.replace("`", "``") + "`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(column, "yyyyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(column))
    if isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)):
        return column
    return None


def _literal(row: Row, table: DataFrame) -> Column:
    """A collected row as a struct of literals."""
    return F.struct(*[F.lit(row[field.name]).cast(field.dataType).alias(field.name) for field in table.schema])


def experiment_class(state: Column) -> Column:
    """``failed``, ``completed`` or ``active``; null for the states in between."""
    return (
        F.when(state.isin(*FAILED), F.lit("failed"))
        .when(state.isin(*COMPLETED), F.lit("completed"))
        .when(state.isin(*ACTIVE), F.lit("active"))
    )


def in_class(experiments: DataFrame, name: str) -> DataFrame:
    return experiments.where(experiment_class(F.col("state")) == name)


def old_completed(experiments: DataFrame, as_of: datetime | Column, days: int = 30) -> DataFrame:
    """Completed experiments that ended more than ``days`` days before ``as_of``."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    cutoff = moment.cast("timestamp") - F.make_dt_interval(F.lit(days))
    return in_class(experiments, "completed").where(F.col("ended_at") < cutoff)


def one_by_id(experiments: DataFrame, experiment_id: int) -> DataFrame:
    return experiments.where(F.col("id") == experiment_id)


def by_name_first(table: DataFrame, position: str = "position", scope: Sequence[str] = ()) -> DataFrame:
    """The first row of each name (within the scope columns) in source order."""
    columns = [name for name in table.columns if name not in ("name", position, *scope)]
    first = F.min_by(F.struct(*columns), position).alias("_first")
    return table.groupBy(*scope, "name").agg(first).select(*scope, "name", "_first.*")


def find_project(workspaces: DataFrame, projects: DataFrame, workspace: str, project: str) -> DataFrame:
    """The first project of a name in the first workspace of a name."""
    first = by_name_first(workspaces.where(F.col("name") == workspace)).select(F.col("id").alias("workspace_id"))
    named = projects.where(F.col("name") == project).join(first, "workspace_id", "left_semi")
    return by_name_first(named, scope=("workspace_id",))


def missing_projects(job_configs: DataFrame, projects: DataFrame) -> DataFrame:
    """``workspace, project`` pairs that configs name and that do not exist."""
    named = job_configs.where(F.length("project") > 0).select("workspace", "project").distinct()
    return named.join(projects.select("workspace", "project"), ["workspace", "project"], "left_anti")


def experiment_report(experiments: DataFrame, show_description: bool = False) -> DataFrame:
    """``id, line``; a description, where asked for and present, follows on an indented line."""
    line = experiment_report_line(F.col("id"), F.col("state"), F.col("owner"), F.col("name"))
    if show_description:
        line = F.concat(line, _indented("description"))
    return experiments.select("id", line.alias("line"))


def _indented(column: str) -> Column:
    return F.when(F.length(column) > 0, F.concat(F.lit("\n    "), column)).otherwise(F.lit(""))


def succeeded() -> Column:
    return F.coalesce(F.col("success").isin("True", "dry-run"), F.lit(False))


def submission_report(submissions: DataFrame) -> DataFrame:
    """``config, line``: the outcome, the new id and, indented, the error."""
    status = F.when(succeeded(), F.lit("[OK] ")).otherwise(F.lit("[FAIL] "))
    number = F.when(F.length("experiment_id") > 0, F.concat(F.lit(" -> "), "experiment_id")).otherwise(F.lit(""))
    return submissions.select("config", F.concat(status, "config", number, _indented("error")).alias("line"))


def submission_summary(submissions: DataFrame) -> DataFrame:
    """Total, succeeded (``True`` or ``dry-run``) and failed submissions."""
    return submissions.agg(
        F.count("*").alias("total"),
        F.count_if(succeeded()).alias("succeeded"),
        F.count_if(~succeeded()).alias("failed"),
    )
