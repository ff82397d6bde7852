"""Text, time and report expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The experiment states.
STATES = (
    "ACTIVE",
    "PAUSED",
    "STOPPING_CANCELED",
    "STOPPING_KILLED",
    "STOPPING_ERROR",
    "STOPPING_COMPLETED",
    "CANCELED",
    "COMPLETED",
    "ERROR",
    "DELETED",
    "DELETE_FAILED",
    "QUEUE",
    "PULLING",
    "STARTING",
    "RUNNING",
    "UNSPECIFIED",
)

ISO_STAMP = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:\d{2})?)?$"
)


def normalize_state(raw: Column) -> Column:
    """Drop the ``STATE_`` prefix; anything outside the enum is UNSPECIFIED."""
    name = F.replace(F.coalesce(raw, F.lit("")), F.lit("STATE_"), F.lit(""))
    return F.when(name.isin(*STATES), name).otherwise(F.lit("UNSPECIFIED"))


def parse_ts(text: Column) -> Column:
    """ISO-8601 text to timestamp; empty or malformed text gives null."""
    # Spark wants seconds where there is a zone
    zone = r"(Z|[+-]\d{2}:\d{2})?$"
    with_minutes = F.regexp_replace(text, r"^(.{10}[T ]\d{2})" + zone, "$1:00$2")
    with_seconds = F.regexp_replace(with_minutes, r"^(.{10}[T ]\d{2}:\d{2})" + zone, "$1:00$2")
    return F.when(text.rlike(ISO_STAMP), F.try_to_timestamp(with_seconds))


def iso_ts(stamp: Column) -> Column:
    """Timestamp to ISO-8601 text in UTC; the fraction only shows when there is one."""
    fraction = F.unix_micros(stamp) % F.lit(1_000_000) != 0
    text = F.when(fraction, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    )
    return F.concat(text, F.lit("+00:00"))


def fixed_point(value: Column, digits: int) -> Column:
    """Decimal text rounded from the exact binary value, ties to even.

    Java formats round the shortest decimal form half up, so 2.675 would give
    2.68 where the exact value lies below the tie. Here the value is split in
    two halves whose scaled products are exact, so that the comparison with
    the tie is exact too.
    """
    scale = 10**digits
    size = F.abs(value.cast("double"))
    shifted = size * F.lit(134217729.0)
    high = shifted - (shifted - size)
    low = size - high
    below = F.floor(size * scale)
    from_tie = (high * scale - below - F.lit(0.5)) + low * scale
    up = (from_tie > 0) | ((from_tie == 0) & (below % 2 == 1))
    units = below + up.cast("long")
    whole = ((units - units % scale) / scale).cast("long")
    text = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        whole.cast("string"),
        F.lit("."),
        F.lpad((units % scale).cast("string"), digits, "0"),
    )
    infinite = size == F.lit(float("inf"))
    return (
        F.when(F.isnan(size), F.lit("nan"))
        .when(infinite, F.when(value < 0, F.lit("-inf")).otherwise(F.lit("inf")))
        .otherwise(text)
    )


def format_size(size: Column) -> Column:
    """Bytes as text, divided by 1024 until below it; PB has no upper end."""
    size = size.cast("double")
    scaled, unit = None, None
    for power, name in enumerate(("B", "KB", "MB", "GB", "TB")):
        fits, value = size < float(1024 ** (power + 1)), size / float(1024**power)
        scaled = F.when(fits, value) if scaled is None else scaled.when(fits, value)
        unit = F.when(fits, F.lit(f" {name}")) if unit is None else unit.when(fits, F.lit(f" {name}"))
    # NaN is above everything in Spark and so falls through to PB, as it should
    scaled, unit = scaled.otherwise(size / float(1024**5)), unit.otherwise(F.lit(" PB"))
    return F.concat(fixed_point(scaled, 2), unit)


def format_duration(seconds: Column) -> Column:
    """``12.3s``, ``4m 5s`` or ``1h 2m 3s``; whole parts are cut off, not rounded."""
    seconds = seconds.cast("double")

    def quotient(value: Column, unit: int) -> Column:
        return F.round((value - value % unit) / unit).cast("long").cast("string")

    within_hour = seconds % 3600
    rest = F.floor(seconds % 60).cast("string")
    return (
        F.when(seconds < 60, F.concat(fixed_point(seconds, 1), F.lit("s")))
        .when(seconds < 3600, F.concat(quotient(seconds, 60), F.lit("m "), rest, F.lit("s")))
        .otherwise(
            F.concat(
                quotient(seconds, 3600),
                F.lit("h "),
                quotient(within_hour, 60),
                F.lit("m "),
                rest,
                F.lit("s"),
            )
        )
    )


def pad_right(text: Column, width: int) -> Column:
    """At least ``width`` characters; longer text stays whole."""
    return F.when(F.char_length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def pad_left(text: Column, width: int) -> Column:
    return F.when(F.char_length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def pool_report_line(name: Column, available: Column, total: Column, utilization: Column) -> Column:
    return F.concat(
        pad_right(name, 30),
        F.lit(" free:"),
        pad_left(available.cast("string"), 3),
        F.lit(" total:"),
        pad_left(total.cast("string"), 3),
        F.lit(" util:"),
        pad_left(fixed_point(utilization * 100, 1), 5),
        F.lit("%"),
    )


def experiment_report_line(id_: Column, state: Column, owner: Column, name: Column) -> Column:
    return F.concat(
        pad_left(id_.cast("string"), 6),
        F.lit(" "),
        pad_right(state, 15),
        F.lit(" "),
        pad_right(owner, 15),
        F.lit(" "),
        name,
    )


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_extract(path_name(path), r"^(.+?)(\.[^.]+)?$", 1)


def decode_names(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")
