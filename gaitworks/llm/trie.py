"""Prefix trie of conversations by digests of blocks of turns.

Turns are hashed, and the digest of a prefix is the exclusive or of the hashes
of (depth, turn). Conversations are grouped by the digests of prefixes that
end with a block of ``BLOCK`` turns first: any number of conversations with
equal blocks become one row. Only where several blocks follow one prefix are
these rows, not the conversations, opened at their turns and grouped again;
elsewhere all turns of a block have the members of the block.

Every node belongs to the path of its least member: that path runs from some
depth down to the end of this conversation. So sums over subtrees are sums
over a path from below, after the totals of the paths that hang on it, which
come from pointer jumping over paths, in a logarithmic number of rounds.
Everything is keyed by conversation and depth, or by prefix, and aggregated
before it is shuffled; texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaitworks.llm.common import prepared, stored
from gaitworks.operators.indexing import sample_index

#: Turns of a block.
BLOCK = 4
#: Rows of one conversation that a window goes through; longer ones are summed in pieces.
SPAN = 1 << 12
#: Ids with equal upper bits, at most so many to the power of two, are joined into one string.
ID_BITS = 12
_ORDER = ("turn", "turn1", "turn2")


def ordered(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 0), 62-bit hashes of a turn and the UTF-8 ``bytes`` of its text.

    By turn, nulls first; rows of one turn by their hashes. Null roles and texts
    count as empty, rows without a ``conv_id`` belong to no conversation and go.
    """
    prepared(conversations.sparkSession)
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    hashes = [F.shiftright(F.xxhash64(*parts), 2) for parts in ((role, text), (F.lit(7), text, role))]
    narrow = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        hashes[0].alias("turn1"),
        hashes[1].alias("turn2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return sample_index(stored(narrow, "turns"), ["conv_id"], _ORDER, name="place").drop("turn")


def regrouped(turns: DataFrame, every: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns and rebuilt conversations, from what ``ordered`` returns.

    Conversation c gets the first h turns of conversation c - c % ``every``, h
    being CRC-32 of c's decimal text modulo ``modulus``, and its own ones after
    its first h. Returns ``conv_id, depth`` (from 1), hashes, ``bytes`` and
    ``length``, and ``conv_id, length`` of all, turnless ones too.
    """
    turns = stored(turns, "ordered")
    conv = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg((F.max("place") + 1).alias("n"))
    info = sizes.withColumns({"head": conv - conv % every, "h": F.crc32(conv.cast("string").cast("binary")) % modulus})
    heads = info.filter("conv_id = head").select("head", F.col("n").alias("head_n"))
    taken = F.least(F.col("h"), F.coalesce("head_n", F.lit(0)))
    own = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    length = F.when(F.col("head") == conv, F.col("n")).otherwise(taken + own)
    info = info.join(heads, "head", "left").select("conv_id", "head", "h", taken.alias("taken"), length.alias("length"))
    info = stored(info, "conversations")
    hashes = ["turn1", "turn2", "bytes"]
    depth = F.when(F.col("head") == conv, F.col("place")).otherwise(F.col("taken") + F.col("place") - F.col("h")) + 1
    kept = turns.join(info, "conv_id").filter("head = conv_id OR place >= h").select("conv_id", depth.alias("depth"), *hashes, "length")
    first = turns.filter((conv % every == 0) & (F.col("place") < modulus - 1)).withColumnRenamed("conv_id", "head")
    given = first.join(info.filter("head <> conv_id"), "head").filter("place < h")
    given = given.select("conv_id", (F.col("place") + 1).alias("depth"), *hashes, "length")
    return kept.unionByName(given), info.select("conv_id", "length")


def _running(df: DataFrame, values: list[str], order: str, total: Callable, plus: Callable, down: bool = True) -> DataFrame:
    """Running totals per ``conv_id`` along a dense order, this row included, in pieces of ``SPAN`` rows.

    ``down`` goes from small to large orders. Only a conversation of several
    pieces needs the totals of whole pieces, of which there are few.
    """
    spark_order = F.col(order) if down else -F.col(order)
    df = df.withColumn("_piece", F.call_function("div", F.col(order), F.lit(SPAN)))
    within = Window.partitionBy("conv_id", "_piece").orderBy(spark_order).rowsBetween(Window.unboundedPreceding, 0)
    sums = stored(df.repartition("conv_id", "_piece").withColumns({f"_{v}": total(v).over(within) for v in values}), "running")
    if sums.filter("_piece > 0").isEmpty():
        return sums.withColumns({v: F.col(f"_{v}") for v in values}).select(*[c for c in df.columns if c != "_piece"])
    pieces = sums.join(sums.filter("_piece > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    pieces = pieces.groupBy("conv_id", "_piece").agg(*[total(v).alias(f"_all_{v}") for v in values])
    piece_order = F.col("_piece") if down else -F.col("_piece")
    earlier = Window.partitionBy("conv_id").orderBy(piece_order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("conv_id", "_piece", *[F.coalesce(total(f"_all_{v}").over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values])
    placed = sums.join(pieces, ["conv_id", "_piece"], "left")
    added = {v: plus(F.col(f"_{v}"), F.coalesce(F.col(f"_before_{v}"), F.lit(0))) for v in values}
    return placed.withColumns(added).select(*[c for c in df.columns if c != "_piece"])


def _xor(*columns: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def blocks(turns: DataFrame) -> DataFrame:
    """One row per block of a conversation: its turns side by side, and the digests of the prefix before and with it."""
    lanes = {
        "g1": F.xxhash64("depth", "turn1", "turn2"),
        "g2": F.xxhash64(F.lit(7), "depth", "turn2", "turn1"),
    }
    at = F.col("depth") - 1
    block = F.call_function("div", at, F.lit(BLOCK))
    rows = turns.withColumns({**lanes, "block": block, "at": at % BLOCK, "_piece": F.call_function("div", block, F.lit(SPAN))})
    sides = [
        F.max(F.when(F.col("at") == i, F.col(name))).alias(f"{name}_{i}") for i in range(BLOCK) for name in ("g1", "g2", "bytes")
    ]
    wide = rows.repartition("conv_id", "_piece").groupBy("conv_id", "_piece", "block").agg(
        F.count("*").alias("turns"), F.max("length").alias("length"), F.bit_xor("g1").alias("own1"), F.bit_xor("g2").alias("own2"), *sides
    )
    wide = wide.drop("_piece").withColumns({"x1": F.col("own1"), "x2": F.col("own2")})
    found = _running(wide, ["x1", "x2"], "block", F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    before = {f"y{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"own{i}")) for i in (1, 2)}
    return stored(found.withColumns(before).drop("own1", "own2"), "blocks")


def _opened(groups: DataFrame) -> DataFrame:
    """Groups of equal blocks as one row per turn: prefix digests with it and before it."""
    turns = []
    for i in range(BLOCK):
        digests = {
            f"{name}{lane}": _xor(F.col(f"y{lane}"), *[F.col(f"g{lane}_{j}") for j in range(i + more)])
            for name, more in (("x", 1), ("p", 0))
            for lane in (1, 2)
        }
        depth = (F.col("block") * BLOCK + i + 1).alias("depth")
        turns.append(F.when(F.col("turns") > i, F.struct(depth, *[c.alias(n) for n, c in digests.items()], F.col(f"bytes_{i}").alias("bytes"))))
    return groups.select("conv_id", "n_convs", F.explode(F.filter(F.array(*turns), lambda t: t.isNotNull())).alias("t")).select("conv_id", "n_convs", "t.*")


def _grown(block_rows: DataFrame) -> DataFrame:
    """All nodes below the root: depth, prefix digests of node and parent, bytes, least member and number of members."""
    sides = [f"{name}_{i}" for i in range(BLOCK) for name in ("g1", "g2", "bytes")]
    groups = stored(
        block_rows.groupBy("block", "turns", "x1", "x2").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("y1", "y2", *sides)]
        ),
        "block-groups",
    )
    prefix = ["block", "y1", "y2"]
    # conversations differ in their first block: it is opened in any case
    later = groups.filter("block > 0")
    split = stored(later.groupBy(*prefix).agg(F.count("*").alias("_ways")).filter("_ways > 1"), "split")
    marked = later.join(split, prefix, "left")
    whole = _opened(marked.filter("_ways IS NULL"))
    parted = _opened(groups.filter("block = 0").unionByName(marked.filter("_ways IS NOT NULL").drop("_ways")))
    parted = parted.groupBy("depth", "x1", "x2").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *[F.min(c).alias(c) for c in ("p1", "p2", "bytes")]
    )
    return whole.unionByName(parted)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of a node joined by commas; rows come sorted by node, and only the state is held."""
    current, state, done = None, None, []
    names, types = ["depth", "x1", "x2", "ends_sha256"], [pa.int64()] * 3 + [pa.string()]

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [()] * 4, types)], names=names)

    for batch in batches:
        for depth, x1, x2, ids in zip(*[column.to_pylist() for column in batch.columns]):
            if (depth, x1, x2) == current:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((*current, state.hexdigest()))
            current, state = (depth, x1, x2), hashlib.sha256(ids.encode())
        if len(done) >= 1000:
            yield made()
            done = []
    if state is not None:
        done.append((*current, state.hexdigest()))
    yield made()


def _ends(block_rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids meet in groups of at most 2 ** ``ID_BITS``, as strings; these go through
    one task per node as a stream, as the hash is one of the whole list.
    """
    last = block_rows.filter(F.col("block") * BLOCK + F.col("turns") == F.col("length"))
    last = last.select("conv_id", F.col("length").alias("depth"), "x1", "x2")
    none = conversations.filter("length = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "x1", "x2")])
    node = ["depth", "x1", "x2"]
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    lists = last.unionByName(none).groupBy(*node, F.shiftright("conv_id", ID_BITS).alias("part")).agg(ids.alias("ids"))
    dealt = lists.repartition(*node).sortWithinPartitions(*node, "part").select(*node, "ids")
    return dealt.mapInArrow(_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def _path_totals(paths: DataFrame, root: int) -> DataFrame:
    """``conv_id, up, saved, leaves`` with the sums over all paths that hang on a path, directly or not."""
    label = "paths"
    state = paths.select("conv_id", F.col("up").alias("jump"), "saved", "leaves")
    while True:
        state = stored(state, label)
        moving = state.filter("jump IS NOT NULL")
        if moving.isEmpty():
            return state.select("conv_id", "saved", "leaves")
        gains = moving.groupBy("jump").agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
        gains = gains.withColumnRenamed("jump", "conv_id")
        grown = state.join(gains, "conv_id", "left").select(
            "conv_id",
            # above the root's path there is nothing
            F.when(F.col("jump") != root, F.col("jump")).alias("jump"),
            *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in ("saved", "leaves")],
        )
        above = state.filter("jump IS NOT NULL").select(F.col("conv_id").alias("jump"), F.col("jump").alias("next"))
        far = grown.filter("jump IS NOT NULL").join(above, "jump", "left").select("conv_id", F.col("next").alias("jump"), "saved", "leaves")
        state = grown.filter("jump IS NULL").unionByName(far)


def nodes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node, the root included, of the trie of ``turns`` (``conv_id, depth`` from 1, hashes, bytes, length).

    ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (the parent's;
    null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. ``conversations`` has ``conv_id`` and
    ``length`` of all; without any there is no root and no row. Prefixes are told
    apart by 124 bits or more.
    """
    every = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    root = every.first()
    spark = conversations.sparkSession
    result = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not root["n"]:
        return spark.createDataFrame([], result)
    least = root["conv_id"]
    block_rows = blocks(turns)
    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "x1", "x2", "p1", "p2", "bytes")]
    grown = _grown(block_rows).unionByName(every.select("conv_id", F.col("n").alias("n_convs"), *zero))
    grown = stored(grown, "nodes")
    node = ["depth", "x1", "x2"]
    kids = grown.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
    counted = grown.join(kids.agg(F.count("*").alias("n_children")), node, "left").join(_ends(block_rows, conversations), node, "left")
    children = F.coalesce("n_children", F.lit(0))
    full = stored(
        counted.withColumns(
            {
                "n_children": children,
                "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())),
                "saved": (F.col("n_convs") - 1) * F.col("bytes"),
                "leaves": (children == 0).cast("long"),
            }
        ),
        "trie",
    )
    tops = full.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    tops = stored(tops.select("conv_id", (F.col("top.depth") - 1).alias("depth"), "top.p1", "top.p2", "saved", "leaves"), "tops")
    holders = full.select(F.col("conv_id").alias("up"), "depth", F.col("x1").alias("p1"), F.col("x2").alias("p2")).filter("depth > 0")
    near = tops.filter("depth <= 0").withColumn("up", F.when(F.col("depth") == 0, F.lit(least)).cast("long"))
    deep = tops.filter("depth > 0").join(holders, ["depth", "p1", "p2"])
    paths = stored(near.unionByName(deep.select(*near.columns)), "path-tree")
    totals = _path_totals(paths, least)
    hung = paths.select("conv_id", "up", "depth").join(totals, "conv_id").filter("up IS NOT NULL")
    none = F.lit(0).cast("long")
    marks = hung.select(F.col("up").alias("conv_id"), "depth", F.lit(None).cast("long").alias("up"), F.col("saved").alias("more"), F.col("leaves").alias("more_leaves")).unionByName(
        hung.select("conv_id", (F.col("depth") + 1).alias("depth"), "up", none.alias("more"), none.alias("more_leaves"))
    )
    marks = marks.groupBy("conv_id", "depth").agg(F.max("up").alias("up"), F.sum("more").alias("more"), F.sum("more_leaves").alias("more_leaves"))
    with_marks = full.join(marks, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", none)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more", none)).alias("saved_tokens"),
        "ends_sha256",
    )
    return _running(with_marks, ["n_leaves", "saved_tokens"], "depth", F.sum, lambda a, b: a + b, down=False)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``nodes`` of all conversations as ``regrouped`` rebuilds them; columns besides conv_id, turn, role and text are ignored."""
    return nodes(*regrouped(ordered(conversations)))
