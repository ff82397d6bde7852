"""JSON values as columns of kind and text, as Python's decoder understands them.

A decoded value is a struct ``kind, text``: ``null``, ``boolean``, ``long``,
``double``, ``string``, ``array`` or ``object``, and what Python writes for it
(``None``, ``True``, ``1.0``, ``1e+20``, ``nan``; JSON for containers). An
absent member is a null struct.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<kind: string, text: string>"
VALUE_TYPE = pa.struct([("kind", pa.string()), ("text", pa.string())])


class ABSENT:
    """Stands for a member that is not there; a class, so that it is the same one in every process."""


_KINDS = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "null", dict: "object", list: "array"}


def kind_of(found: object) -> str:
    return _KINDS[type(found)]


def value_of(found: object) -> tuple[str, str] | None:
    """A decoded JSON value as kind and text; none for an absent one."""
    if found is ABSENT:
        return None
    kind = kind_of(found)
    if kind == "string":
        return kind, _clean(found)
    if kind in ("object", "array"):
        return kind, json_text(found)
    return kind, repr(found)


def value_array(values: list[tuple[str, str] | None]) -> pa.Array:
    """What ``value_of`` gives, as a column."""
    kinds = pa.array([None if x is None else x[0] for x in values], pa.string())
    texts = pa.array([None if x is None else x[1] for x in values], pa.string())
    return pa.StructArray.from_arrays([kinds, texts], fields=list(VALUE_TYPE), mask=kinds.is_null())


def json_text(found: object) -> str:
    return _clean(json.dumps(found, ensure_ascii=False, separators=(",", ":")))


def _clean(text: str) -> str:
    """Half of a surrogate pair, which JSON can spell, has no UTF-8."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def as_string(value: Column) -> Column:
    return F.when(value["kind"] != "null", value["text"])


def as_double(value: Column) -> Column:
    return F.when(value["kind"].isin("long", "double", "string"), value["text"].try_cast("double")).when(
        value["kind"] == "boolean", (value["text"] == "True").cast("double")
    )


def as_long(value: Column) -> Column:
    """Numbers are cut, text must be an integer, true is 1; else null."""
    integer = F.when(value["text"].rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value["text"]).try_cast("long"))
    return (
        F.when(value["kind"].isin("long", "string"), integer)
        .when(value["kind"] == "boolean", (value["text"] == "True").cast("long"))
        .when(value["kind"] == "double", value["text"].try_cast("double").try_cast("long"))
    )


def is_true(value: Column) -> Column:
    """Whether a value counts as true: zero, null and empty ones do not."""
    return (
        F.when(value["kind"] == "null", F.lit(False))
        .when(value["kind"] == "boolean", value["text"] == "True")
        .when(value["kind"] == "string", F.length(value["text"]) > 0)
        .when(value["kind"].isin("object", "array"), ~value["text"].isin("{}", "[]"))
        .otherwise(F.coalesce(value["text"].try_cast("double") != 0, F.lit(True)))
    )
