"""Intermediate tables and their clean-up."""

from pathlib import Path

from gaitworks import session
from gaitworks.catalog import QUERIES


def made(spark):
    place = session.shared_dir(spark).removeprefix("file:")
    return {x.name for x in Path(place).glob("gaitworks-*")}


def test_a_scope_leaves_no_tables_behind(spark):
    kept = session.stored(spark.range(3), "kept")
    before = made(spark)
    with session.scratch_scope():
        inner = session.stored(spark.range(10), "inner")
        assert inner.count() == 10 and len(made(spark)) == len(before) + 1
        rows = QUERIES["G3_locate_sample"](spark, "/root/testdata/sf0.001").collect()
        assert rows and len(made(spark)) > len(before) + 1
    assert made(spark) == before and kept.count() == 3


def test_a_scope_is_cleared_after_an_error(spark):
    before = made(spark)
    try:
        with session.scratch_scope():
            session.stored(spark.range(10))
            raise KeyError("x")
    except KeyError:
        pass
    assert made(spark) == before
