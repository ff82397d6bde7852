"""Validation of recordings by their headers, and of datasets by their counts.

Each check returns the offending rows, so that it can be counted, stored or
turned into an error with ``raise_if_any``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.spec import RolloutSpec

EXAMPLES = 3


def raise_if_any(problems: DataFrame, message: str, order: Sequence[str] = ("file_idx",)) -> None:
    """Raise with the first few offending rows; the rest stays on the cluster."""
    first = problems.orderBy(*order).limit(EXAMPLES).collect()
    if first:
        raise ValueError(f"{message}: " + "; ".join(str(row.asDict()) for row in first))


def _shape(name: str) -> Column:
    return F.col("fields")[name]["shape"]


def require_fields(profiled: DataFrame, required: Sequence[str]) -> DataFrame:
    """``file_idx, path, field`` of each required field a file lacks."""
    names = F.array(*[F.lit(name) for name in required])
    lacking = F.array_except(names, F.map_keys("fields"))
    return profiled.select("file_idx", "path", F.explode(lacking).alias("field"))


def check_dims(
    profiled: DataFrame,
    spec: RolloutSpec = RolloutSpec(),
    state: str = "state",
    action: str = "action",
    allow_empty: bool = False,
) -> DataFrame:
    """``file_idx, path, problem`` for ranks, widths and emptiness that the derived dataset cannot take."""
    state_shape, action_shape = _shape(state), _shape(action)

    def width(shape: Column, axis: int) -> Column:
        return F.get(shape, F.lit(axis))

    rules = [
        (F.size(state_shape) != 2, "state rank is not 2"),
        (F.size(action_shape) != 3, "action rank is not 3"),
        (width(state_shape, 0) != width(action_shape, 0), "state and action differ in sample count"),
        (width(state_shape, 1) < spec.state_dim, "state is narrower than state_dim"),
        (width(state_shape, 1) < spec.cmd_dim, "state is narrower than cmd_dim"),
        (width(action_shape, 1) < spec.horizon_steps, "action has fewer steps than the horizon"),
        (width(action_shape, 2) < spec.action_dim, "action is narrower than action_dim"),
    ]
    if not allow_empty:
        rules.append((width(state_shape, 0) == 0, "no samples"))
    # an absent field makes every rule null; that is for require_fields to say
    found = F.array(*[F.when(rule, F.lit(text)) for rule, text in rules])
    return profiled.select("file_idx", "path", F.explode(F.array_compact(found)).alias("problem"))


def check_counts(profiled: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``file_idx, path, field, found, expected``: fields whose sample count differs from the first field's."""
    counts = [
        F.struct(F.lit(name).alias("field"), F.get(_shape(name), F.lit(0)).alias("found")) for name in fields[1:]
    ]
    expected = F.get(_shape(fields[0]), F.lit(0))
    return (
        profiled.select("file_idx", "path", expected.alias("expected"), F.explode(F.array(*counts)).alias("_c"))
        .select("file_idx", "path", "_c.field", "_c.found", "expected")
        .where(F.col("found") != F.col("expected"))
    )


def _field_rows(profiled: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per file and asked field; ``tail`` is the shape without the sample axis, null when absent."""
    asked = [
        F.struct(
            F.lit(name).alias("field"),
            F.when(_shape(name).isNotNull(), F.slice(_shape(name), 2, F.greatest(F.size(_shape(name)) - 1, F.lit(0)))).alias("tail"),
        )
        for name in fields
    ]
    return profiled.select("file_idx", "name", F.explode(F.array(*asked)).alias("_f")).select(
        "file_idx", "name", "_f.field", "_f.tail"
    )


def _judged(profiled: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Field rows with ``missing`` and ``inconsistent`` marks against the first shape seen."""
    rows = _field_rows(profiled, fields)
    first = rows.groupBy("field").agg(
        F.min_by("tail", F.when(F.col("tail").isNotNull(), F.col("file_idx"))).alias("first_tail")
    )
    # one row per asked field, a list given by the caller
    return rows.join(F.broadcast(first), "field").select(
        "file_idx",
        "name",
        "field",
        "first_tail",
        F.col("tail").isNull().alias("missing"),
        (F.col("tail").isNotNull() & (F.col("tail") != F.col("first_tail"))).alias("inconsistent"),
    )


def common_fields(profiled: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, shape, missing_files, inconsistent_files, kept``: kept when in all files with one shape."""
    return (
        _judged(profiled, fields)
        .groupBy("field")
        .agg(
            F.first("first_tail").alias("shape"),
            F.count_if("missing").alias("missing_files"),
            F.count_if("inconsistent").alias("inconsistent_files"),
        )
        .withColumn("kept", (F.col("missing_files") == 0) & (F.col("inconsistent_files") == 0))
    )


def field_report(profiled: DataFrame, fields: Sequence[str], examples: int = EXAMPLES) -> DataFrame:
    """Per field that is not kept: how many files lack it or differ, and the first names of each.

    Names are ranked per field and only the first ones survive the map side,
    so a field that millions of files lack stays cheap.
    """
    flaws = (
        _judged(profiled, fields)
        .select(
            "file_idx",
            "name",
            "field",
            F.when(F.col("missing"), F.lit("missing"))
            .when(F.col("inconsistent"), F.lit("inconsistent"))
            .alias("flaw"),
        )
        .where("flaw is not null")
    )
    counts = flaws.groupBy("field").agg(
        F.count_if(F.col("flaw") == "missing").alias("missing_files"),
        F.count_if(F.col("flaw") == "inconsistent").alias("inconsistent_files"),
    )
    ranked = Window.partitionBy("field", "flaw").orderBy("file_idx")
    first = flaws.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= examples)

    def names(flaw: str) -> Column:
        kept = F.collect_list(F.when(F.col("flaw") == flaw, F.struct("_rank", "name")))
        return F.transform(F.array_sort(kept), lambda entry: entry["name"])

    shown = first.groupBy("field").agg(
        names("missing").alias("missing_examples"), names("inconsistent").alias("inconsistent_examples")
    )
    return counts.join(shown, "field")


def reconcile(samples: DataFrame, files: DataFrame) -> DataFrame:
    """``file_idx, declared, found`` of files whose rows are not 0..declared-1 by count, ends and sum.

    One pass over the position column, summed up before the shuffle.
    """
    position = F.col("sample_idx").cast("decimal(19,0)")
    found = samples.groupBy("file_idx").agg(
        F.count("*").alias("found"),
        F.min("sample_idx").alias("_first"),
        F.max("sample_idx").alias("_last"),
        F.sum(position).alias("_sum"),
    )
    declared = files.select("file_idx", F.col("num_samples").cast("long").alias("declared"))
    both = declared.join(found, "file_idx", "full_outer")
    count = F.coalesce("found", F.lit(0))
    whole = count.cast("decimal(19,0)")
    gaps = (
        (F.col("_first") != 0)
        | (F.col("_last") != count - 1)
        | (F.col("_sum") * 2 != whole * (whole - 1))
    )
    return both.where((F.coalesce("declared", F.lit(0)) != count) | ((count > 0) & gaps)).select(
        "file_idx", F.coalesce("declared", F.lit(0)).alias("declared"), count.alias("found")
    )
