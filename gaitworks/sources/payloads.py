"""Items of a list in JSON documents, each decoded once, by as many tasks as a document has ranges.

A document is cut at the commas and brackets of its two upper levels, which a
scan of the bytes finds: quotes that no backslash escapes tell what is inside a
string, and brackets outside strings give the depth. For a byte range of a file
both need the state at its start. So ranges are scanned under either state
first, sums over the ranges before give the state, and then every range decodes
the pieces that start in it. No task holds a document that is larger than a
range, and a range is read by a few numbers per file, not by the file.

Documents follow Python's decoder: ``NaN`` and ``Infinity`` are numbers, and of
a repeated member the last one counts. Text is UTF-8. A document that is no
JSON is an error, wherever in it; one without the wanted list has no items.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaitworks.functions.values import VALUE_TYPE, value_array
from gaitworks.operators.indexing import sample_index
from gaitworks.operators.joins import join_stored
from gaitworks.session import stored
from gaitworks.sources import storage

#: Bytes of a range of a file; what is read first to find a piece's end beyond it (then twice as much).
RANGE, AHEAD = 16 << 20, 1 << 16
#: Documents up to so many characters are decoded whole.
SMALL = 4 << 20
#: Rows that leave a task at a time.
_BATCH = 2000

_SPACE = b" \t\n\r"
_QUOTE, _ESCAPE, _COMMA, _COLON = ord('"'), ord("\\"), ord(","), ord(":")
_OPENS, _CLOSES = (ord("["), ord("{")), (ord("]"), ord("}"))
_BEGIN, _END = -1, -2
_MARKS = np.zeros(256, bool)
_MARKS[[_COMMA, _COLON, *_OPENS, *_CLOSES]] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(_OPENS)], _STEP[list(_CLOSES)] = 1, -1


def _broken(why: str, where: int, start: bytes = b"") -> ValueError:
    return ValueError(f"a payload is no JSON document: {why} near byte {where}; {start[:80]!r}")


# ---------------------------------------------------------------- the scan of bytes


def _quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that no backslash escapes; ``escaped`` says that the first byte is."""
    quotes = np.flatnonzero(data == _QUOTE)
    escapes = np.flatnonzero(data == _ESCAPE)
    if escaped and len(escapes) and escapes[0] == 0:
        escapes = escapes[1:]  # an escaped backslash escapes nothing
    if len(escapes) and len(quotes):
        # backslashes in a row: after an odd number of them the next byte is escaped
        first = np.flatnonzero(np.diff(escapes, prepend=-2) != 1)
        lengths = np.diff(first, append=len(escapes))
        after = escapes[first] + lengths
        quotes = quotes[~np.isin(quotes, after[lengths % 2 == 1])]
    if escaped and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    return quotes


def _outside(data: np.ndarray, quotes: np.ndarray, in_string: bool) -> np.ndarray:
    """Places of commas, colons and brackets that are not inside a string."""
    marks = np.flatnonzero(_MARKS[data])
    return marks[(np.searchsorted(quotes, marks) + in_string) % 2 == 0]


def _ends_escaped(data: bytes, escaped: bool) -> bool:
    """Whether the byte after these ones is escaped."""
    run = len(data) - len(data.rstrip(b"\\"))
    return bool((run - (escaped and run == len(data) > 0)) % 2) if data else escaped


@dataclass(frozen=True)
class State:
    """What is known of the document before a byte: inside a string, brackets open, the outermost one (0 before it)."""

    in_string: bool = False
    depth: int = 0
    outer: int = 0


def _events(data: bytes, base: int, state: State, escaped: bool) -> tuple[list[tuple[int, int, int]], State]:
    """``place, byte, level`` of the marks of the two upper levels, and the state behind the data."""
    array = np.frombuffer(data, np.uint8)
    quotes = _quotes(array, escaped)
    places = _outside(array, quotes, state.in_string)
    kinds = array[places]
    steps = _STEP[kinds]
    depth = state.depth + np.cumsum(steps)
    # a bracket stands on the level around it
    level = depth - (steps > 0)
    if len(depth) and depth.min() < 0:
        raise _broken("a bracket too many", base + int(places[int(np.argmin(depth))]))
    kept = np.flatnonzero(np.where(steps != 0, level <= 1, level <= 2))
    found = list(zip((places[kept] + base).tolist(), kinds[kept].tolist(), level[kept].tolist()))
    outer = state.outer or next((kind for _, kind, _ in found), 0)
    end = int(depth[-1]) if len(depth) else state.depth
    return found, State(bool((len(quotes) + state.in_string) % 2), end, outer)


# ---------------------------------------------------------------- the pieces of a range


class _Source:
    """Bytes of a document from ``start`` on; ``read(at, length)`` gives what is there, nothing behind the end."""

    def __init__(self, read: Callable[[int, int], bytes], start: int, end: int, length: int, state: State):
        self.read, self.base, self.end, self.length, self.ahead = read, start, end, length, AHEAD
        back = start
        while back > 0:  # as far back as there are backslashes in a row
            part = read(max(0, back - 64), min(64, back))
            if part.rstrip(b"\\"):
                break
            back -= len(part)
        before = read(max(0, back - 64), start - max(0, back - 64))
        self.escaped = _ends_escaped(before, False)
        self.data = read(start, end - start)
        self.events, self.state = _events(self.data, start, state, self.escaped)
        self.escaped = _ends_escaped(self.data, self.escaped)

    def more(self) -> bool:
        """Read on behind the range; false at the document's end."""
        at = self.base + len(self.data)
        if at >= self.length:
            return False
        part = self.read(at, min(self.ahead, self.length - at))
        self.ahead *= 2
        found, self.state = _events(part, at, self.state, self.escaped)
        self.escaped = _ends_escaped(part, self.escaped)
        self.events += found
        self.data += part
        return True

    def slice(self, start: int, end: int) -> bytes:
        return self.data[start - self.base : end - self.base]


def _value(content: bytes, at: int) -> object:
    try:
        return json.loads(content.decode("utf-8", "replace"))
    except (ValueError, RecursionError) as error:
        raise _broken(str(error)[:200], at, content.strip(_SPACE)) from error


def _pieces(source: _Source, first: bool, state: State) -> Iterator[tuple[str, int, object]]:
    """What starts in the range, in order: ``key``, ``open`` (with its bracket) and ``item`` with places; ``kind`` at the end.

    Each two marks in a row belong to the range that the first one is in, and
    what may stand between them depends on both alone, but for the kind of the
    bracket that was open before the range: ``kind`` says which kinds its
    pieces imply and which one is open behind the range.
    """
    implied: set[int] = set()
    inner: int | None = None  # the bracket that this range has opened on the second level
    last = (source.base, _BEGIN, 0) if first else None
    number = 0
    while True:
        while number >= len(source.events) and source.more():
            pass
        now = source.events[number] if number < len(source.events) else (source.length, _END, 0)
        number += 1
        if last is not None:
            place, kind, level = last
            content = source.slice(place + (kind != _BEGIN), now[0])
            blank = not content.strip(_SPACE)
            yield from _between(kind, level, now, content, blank, place, source.state.outer or state.outer)
            if level == 2 or (kind in _OPENS and level == 1):
                implies = _implied(kind, now, blank)
                if implies and inner not in (None, implies):
                    raise _broken("mixed members and items", place)
                if implies and inner is None:
                    implied.add(implies)
        if now[1] == _END:
            break
        if now[0] >= source.end:
            break
        if now[1] in _OPENS and now[2] == 1:
            inner = now[1]
        last = now
    yield "kind", source.base, (implied, inner)


def _implied(kind: int, now: tuple[int, int, int], blank: bool) -> int | None:
    """The bracket that holds a piece between these marks."""
    if kind in _OPENS and blank and now[1] in _CLOSES:
        return ord("[") if now[1] == ord("]") else ord("{")
    if now[1] == _COLON or kind == _COLON:
        return None if kind == _COLON and now[1] == ord("]") else ord("{")
    return ord("[")


def _between(kind: int, level: int, now: tuple[int, int, int], content: bytes, blank: bool, at: int, outer: int) -> Iterator[tuple[str, int, object]]:
    """Check, and decode, what stands between two marks in a row."""
    place, next_kind, next_level = now
    wrong = _broken("something misplaced", at, content)
    if kind == _BEGIN:
        if next_kind == _END:
            _value(content, at)
        elif not (next_kind in _OPENS and blank):
            raise wrong
    elif kind in _CLOSES and level == 0:
        if next_kind != _END or not blank:
            raise wrong
    elif next_kind == _END:
        raise wrong
    elif kind in _CLOSES:
        # a container of the second level has ended
        ends = (next_kind == _COMMA and next_level == 1) or (next_kind in _CLOSES and next_kind - outer == 2)
        if not (blank and ends):
            raise wrong
    elif level == 1 and kind not in _OPENS or level == 0:
        # inside the outermost bracket
        closing = next_kind in _CLOSES
        if closing and next_kind - outer != 2:
            raise wrong
        if outer == ord("{") and kind != _COLON:
            if closing:
                if not (blank and kind in _OPENS):
                    raise wrong
            elif next_kind == _COLON:
                name = _value(content, at)
                if not isinstance(name, str):
                    raise wrong
                yield "key", place, name
            else:
                raise wrong
        elif next_kind == _COLON or (kind == _COLON and outer != ord("{")):
            raise wrong
        elif next_kind in _OPENS:
            if not blank:
                raise wrong
            yield "open", place, next_kind
        elif not (closing and blank and kind in _OPENS):
            _value(content, at)
    else:
        # inside a bracket of the second level
        closing = next_kind in _CLOSES
        if kind == _COLON:
            if next_kind == ord("]") or next_kind == _COLON:
                raise wrong
            _value(content, at)
        elif next_kind == _COLON:
            if kind == ord("[") or not isinstance(_value(content, at), str):
                raise wrong
        elif kind in _OPENS and closing and blank:
            if next_kind - kind != 2:
                raise wrong
        elif kind == ord("{") or next_kind == ord("}"):
            raise wrong
        else:
            yield "item", at, _value(content, at)


def _wanted(keys: list[tuple[str, int, object]], member: str) -> tuple[int, int | None] | None:
    """Places of the bracket of the last member of that name, and of the next key or bracket; none if it is no list."""
    found = None
    for number, (what, _, name) in enumerate(keys):
        if what == "key" and name == member:
            follows = keys[number + 1] if number + 1 < len(keys) else None
            if follows is None or follows[0] != "open" or follows[2] != ord("["):
                found = None
            else:
                found = follows[1], keys[number + 2][1] if number + 2 < len(keys) else None
    return found


def items_of(text: str, member: str) -> Iterable[object]:
    """The items of a document's top-level list, each decoded once."""
    if len(text) <= SMALL:
        try:
            document = json.loads(text)
        except (ValueError, RecursionError) as error:
            raise _broken(str(error)[:200], 0, text[:80].encode()) from error
        held = document.get(member) if isinstance(document, dict) else None
        return held if isinstance(held, list) else ()
    return _items_of_bytes(text.encode("utf-8", "replace"), member)


def _items_of_bytes(data: bytes, member: str) -> Iterator[object]:
    """A whole document in memory, item by item: its marks say which list counts before anything is decoded."""
    source = _Source(lambda at, length: data[at : at + length], 0, len(data), len(data), State())
    if source.state.depth or source.state.in_string:
        raise _broken("it ends too early", len(data), data)
    marks = [event for event in source.events if event[2] <= 1]
    keys: list[tuple[str, int, object]] = []
    for before, now in zip([(0, _BEGIN, 0), *marks], marks):
        if now[1] == _COLON and now[2] == 1:
            keys.append(("key", now[0], _value(data[before[0] + 1 : now[0]], before[0])))
        elif now[1] in _OPENS and now[2] == 1:
            keys.append(("open", now[0], now[1]))
    place = _wanted(keys, member)
    low, high = place or (0, 0)
    for what, at, found in _pieces(source, True, State()):
        if what == "item" and low <= at and (high is None or at < high):
            yield found


# ---------------------------------------------------------------- rows


def _arrays(rows: list[tuple], types: pa.Schema) -> list[pa.Array]:
    columns = zip(*rows) if rows else [()] * len(types)
    return [value_array(list(c)) if field.type == VALUE_TYPE else pa.array(c, field.type) for c, field in zip(columns, types)]


def decoded(
    payloads: DataFrame,
    member: str,
    rows_of: Callable[[object], Iterable[tuple]],
    schema: str,
    payload: str = "payload",
) -> DataFrame:
    """What ``rows_of`` makes of each item, beside its ``position`` in the list and the payload's other columns.

    A null payload has no items.
    """
    kept = [name for name in payloads.columns if name != payload]
    made = T.StructType.fromDDL(f"position int, {schema}")
    out = T.StructType([*payloads.select(*kept).schema, *made])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(made)
        for batch in batches:
            texts, place = batch.column(0), [batch.column(i) for i in range(1, batch.num_columns)]
            owners: list[int] = []
            rows: list[tuple] = []
            for owner in range(batch.num_rows):
                text = texts[owner].as_py()
                if text is None:
                    continue
                for at, item in enumerate(items_of(text, member)):
                    for row in rows_of(item):
                        owners.append(owner)
                        rows.append((at, *row))
                    if len(rows) >= _BATCH:
                        yield pa.RecordBatch.from_arrays([c.take(pa.array(owners, pa.int64())) for c in place] + _arrays(rows, types), out.names)
                        owners, rows = [], []
            if rows:
                yield pa.RecordBatch.from_arrays([c.take(pa.array(owners, pa.int64())) for c in place] + _arrays(rows, types), out.names)

    return payloads.select(F.col(payload), *kept).mapInArrow(read, out)


# ---------------------------------------------------------------- files


def _open(path: str):
    system, inner = storage.resolve(path)
    return system.open_input_file(inner)


def _reader(file) -> Callable[[int, int], bytes]:
    def read(at: int, length: int) -> bytes:
        file.seek(at)
        return file.read(length)

    return read


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: its quotes, and brackets under either state at its start; its first byte that is no space."""
    names = ["path", "start", "quotes", "depth0", "depth1", "first"]
    for batch in batches:
        for path, start, end, length in zip(*[c.to_pylist() for c in batch.columns[:4]]):
            with _open(path) as file:
                read = _reader(file)
                # as _Source does, for the backslashes before the range
                source = _Source(read, start, start, length, State(True))
                data = read(start, end - start)
            array = np.frombuffer(data, np.uint8)
            quotes = _quotes(array, source.escaped)
            depths = [int(_STEP[array[_outside(array, quotes, inside)]].sum()) for inside in (False, True)]
            solid = data.lstrip(_SPACE)[:1]
            values = [path, start, len(quotes), *depths, solid[0] if solid else None]
            yield pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.array([x], pa.int64()) for x in values], names)


def _ranges(spark: SparkSession, path: str, size: int) -> tuple[DataFrame, int, bool]:
    """``path, start, end, length`` of the ranges of all files, with the state at each start; tasks to read them in; whether a file has several."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    sizes = listed.agg(F.max("length").alias("most"), F.coalesce(F.sum("length"), F.lit(0)).alias("all")).first()
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-sizes["all"] // size))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    cut = listed.select("path", F.explode(starts).alias("start"), "length")
    cut = cut.select("path", "start", F.least(F.col("start") + size, "length").alias("end"), "length")
    none = [F.lit(False).alias("in_string"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("outer")]
    whole = cut.filter(F.col("length") <= size).select("*", *none)
    if (sizes["most"] or 0) <= size:
        return whole, tasks, False
    parts = cut.filter(F.col("length") > size)
    dealt = parts.repartition(tasks, "path", "start")
    found = dealt.mapInArrow(_scan, "path string, start long, quotes long, depth0 long, depth1 long, first long")
    found = stored(parts.join(found, ["path", "start"]), "range-states")
    # a row per range: a terabyte in one document is 65,536 of them
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1
    states = found.withColumn("in_string", inside).withColumn("_step", F.when(F.col("in_string"), F.col("depth1")).otherwise(F.col("depth0")))
    states = states.withColumn("depth", F.coalesce(F.sum("_step").over(earlier), F.lit(0)))
    outer = F.first("first", ignorenulls=True).over(earlier)
    last = (F.col("end") == F.col("length")) & ((F.col("depth") + F.col("_step") != 0) | ((F.col("quotes") + F.col("in_string").cast("int")) % 2 == 1))
    depth = F.when(last, F.raise_error(F.concat(F.lit("a payload is no JSON document: it ends too early; "), "path"))).otherwise(F.col("depth"))
    states = states.select(*cut.columns, "in_string", depth.cast("long").alias("depth"), F.coalesce(outer, F.lit(0)).cast("long").alias("outer"))
    return whole.unionByName(states), tasks, True


def decoded_files(
    spark: SparkSession, path: str, member: str, rows_of: Callable[[object], Iterable[tuple]], schema: str, positions: bool = False, range_bytes: int = RANGE
) -> DataFrame:
    """``path`` and what ``rows_of`` makes of each item of a file's list; with ``positions``, each item's place in it, too.

    ``path`` is a file, folder or pattern as Spark's readers take it (they pass
    over hidden and empty files); tasks read the files' byte ranges.
    """
    made = T.StructType.fromDDL(schema)
    out = T.StructType.fromDDL("path string, _at long, _what string, _name string, _kinds array<int>, _split boolean")
    out = T.StructType([*out, *made])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(out)
        empty = (None,) * len(made)

        for batch in batches:
            for file_path, start, end, length, in_string, depth, outer in zip(*[c.to_pylist() for c in batch.columns]):
                rows: list[tuple] = []
                with _open(file_path) as file:
                    if length <= range_bytes:
                        for number, item in enumerate(items_of(file.read().decode("utf-8", "replace"), member)):
                            rows += [(file_path, number, "item", None, None, False, *row) for row in rows_of(item)]
                            if len(rows) >= _BATCH:
                                yield pa.RecordBatch.from_arrays(_arrays(rows, types), out.names)
                                rows = []
                    else:
                        state = State(in_string, depth, outer)
                        source = _Source(_reader(file), start, end, length, state)
                        for what, at, found in _pieces(source, start == 0, state):
                            if what == "item":
                                rows += [(file_path, at, what, None, None, True, *row) for row in rows_of(found)]
                            elif what == "kind":
                                implied, inner = found
                                rows.append((file_path, at, what, None, [*sorted(implied), -(inner or 0)], True, *empty))
                            else:
                                rows.append((file_path, at, what, found if what == "key" else chr(found), None, True, *empty))
                            if len(rows) >= _BATCH:
                                yield pa.RecordBatch.from_arrays(_arrays(rows, types), out.names)
                                rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(_arrays(rows, types), out.names)

    ranges, tasks, several = _ranges(spark, path, range_bytes)
    items = ranges.repartition(tasks, "path", "start").mapInArrow(read, out)
    if several or positions:
        items = stored(items, "items")
    if several:
        items = items.filter("NOT _split").unionByName(_in_wanted_list(items.filter("_split"), member))
    if not positions:
        return items.select("path", *made.names)
    return sample_index(items, ["path"], ["_at"], name="position").select("path", F.col("position").cast("int").alias("position"), *made.names)


def _in_wanted_list(split: DataFrame, member: str) -> DataFrame:
    """The items of the list that counts, of documents in several ranges, after the check that ranges agree."""
    in_order = Window.partitionBy("path").orderBy("_at")
    kinds = split.filter("_what = 'kind'").select("path", "_at", F.slice("_kinds", 1, F.size("_kinds") - 1).alias("implied"), F.element_at("_kinds", -1).alias("inner"))
    known = F.last(F.when(F.col("inner") != 0, -F.col("inner")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    wrong = kinds.withColumn("_known", known).filter((F.size("implied") > 1) | ((F.size("implied") == 1) & (F.element_at("implied", 1) != F.col("_known"))))
    first = wrong.select("path").first()
    if first is not None:
        raise _broken("mixed members and items", 0, first["path"].encode())
    keys = split.filter("_what IN ('key', 'open')").select("path", "_at", "_what", "_name")
    following = [F.lead(c, n).over(in_order).alias(f"{c}{n}") for n, c in ((1, "_what"), (1, "_name"), (1, "_at"), (2, "_at"))]
    named = keys.select("path", "_at", "_what", "_name", *following).filter((F.col("_what") == "key") & (F.col("_name") == member))
    last = named.groupBy("path").agg(F.max_by(F.struct("_what1", "_name1", "_at1", "_at2"), "_at").alias("list"))
    lists = last.filter("list._what1 = 'open' AND list._name1 = '['").select("path", F.col("list._at1").alias("_from"), F.col("list._at2").alias("_to"))
    items = split.filter("_what = 'item'")
    held = join_stored(items, stored(lists, "lists"), ["path"], F.col("_at"))
    return held.filter((F.col("_at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))).select(*split.columns)
