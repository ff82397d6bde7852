"""Joins of a large side, whose keys may be very uneven, with a lookup side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.session import stored, stored_bytes

BROADCAST_BYTES = 8 << 20
SALTS = 64


def join_lookup(
    large: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """Join with a narrow lookup side, broadcast only if it is known to be small.

    The lookup side is computed once, into the shared folder, and the size of
    its files decides. A larger lookup is repeated once per salt and the large
    side's rows are dealt to the salts by ``spread``, so that a key which holds
    a third of all rows is joined by many tasks, and no later window takes over
    a partitioning by the bare key.
    """
    return join_stored(large, stored(lookup, "lookup"), keys, spread, how, max_bytes, salts)


def join_stored(
    large: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """``join_lookup`` with a lookup side that is stored already."""
    keys = list(keys)
    if stored_bytes(lookup) <= max_bytes:
        return large.join(F.broadcast(lookup), keys, how)
    dealt = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(dealt, [*keys, "_salt"], how).drop("_salt")
