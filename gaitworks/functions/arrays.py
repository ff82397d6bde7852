"""Projections and scalars over state and action arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaitworks.spec import RolloutSpec


def to_float32(values: Column | str, rank: int = 1) -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return values.cast("array<" * rank + "float" + ">" * rank)


def trim_state(state: Column | str, dim: int) -> Column:
    return F.slice(state, 1, dim)


def command(state: Column | str, dim: int) -> Column:
    """The command vector is the leading part of the state."""
    return F.slice(state, 1, dim)


def trim_action(action: Column | str, steps: int, dim: int) -> Column:
    return F.transform(F.slice(action, 1, steps), lambda step: F.slice(step, 1, dim))


def segment_norm(state: str, segment: tuple[int, int], width: int | None = None) -> Column:
    """L2 norm of elements start..end-1 of the named column as float32; missing ones count as zero.

    Written as one sum of products, which stays inside generated code; a
    higher-order aggregate is interpreted and measured four times slower.
    The squares are summed in double. As SQL text it is one call to the JVM
    rather than hundreds.
    """
    start, end = segment
    if width is not None:
        end = min(end, width)
    values = [f"coalesce(double(get(`{state}`, {position})), 0D)" for position in range(start, end)]
    squares = " + ".join(f"{value} * {value}" for value in values) or "0D"
    return F.expr(f"float(sqrt({squares}))")


def exceeds(norm: Column, threshold: float) -> Column:
    """Strictly above, compared in float32; NaN never is (Spark holds NaN for the largest value)."""
    return F.nanvl(norm, F.lit(float("-inf")).cast("float")) > F.lit(threshold).cast("float")


def segment_norms(state: str, spec: RolloutSpec) -> dict[str, Column]:
    return {
        "joint_vel_norm": segment_norm(state, spec.joint_velocity, spec.state_dim),
        "base_lin_norm": segment_norm(state, spec.linear_velocity, spec.state_dim),
        "base_ang_norm": segment_norm(state, spec.angular_velocity, spec.state_dim),
    }


def recovery_flag(state: str, spec: RolloutSpec) -> Column:
    """1.0 when any velocity norm is above its threshold, else 0.0."""
    norms = segment_norms(state, spec)
    unstable = (
        exceeds(norms["base_ang_norm"], spec.ang_threshold)
        | exceeds(norms["joint_vel_norm"], spec.joint_threshold)
        | exceeds(norms["base_lin_norm"], spec.lin_threshold)
    )
    return unstable.cast("float")


def elementwise_delta(later: Column | str, state: Column | str) -> Column:
    return F.zip_with(later, state, lambda a, b: a - b)
