"""Packing of documents into token sequences by best-fit decreasing.

Documents are tokenized in one pass. An overlong one is first cut into full
windows; what is left of it, and every other document, is a piece. Pieces are
dealt to groups of bounded size, and each group is packed by decreasing length:
a segment tree indexed by remaining capacity finds the open sequence into which
a piece fits most tightly. Only lengths are needed for that, so what travels is
a narrow row unless the caller wants the ids to come along.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.bpe import read_ranks
from gaitworks.llm.common import free_name, prepared, quoted, stored
from gaitworks.llm.groups import by_group

CAPACITY, END = 2048, 1
#: Pieces packed together, on average.
GROUP_PIECES = 50_000


def _little(ids) -> bytes:
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def tokenize(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, text: str = "text", end: int | None = END, ids: str = "ids"
) -> DataFrame:
    """Every row, without the text, with the token ids of the whole text (and the end id) as little-endian 32-bit values.

    ``vocabulary`` is the path of a tokenizer file on every worker. ``ranks``
    may give the same vocabulary as a rank file: texts whose characters all
    lie below U+0250, where the two libraries' character classes are the same,
    are then encoded with it, which takes a fifth of the time; all others go
    through the tokenizer. Null text is empty, a text of any length is taken
    whole, an empty table gives no rows. A column of the input that is named
    ``ids`` is replaced.
    """
    prepared(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), ids.lower())]
    schema = docs.select(*[quoted(c) for c in kept]).schema.add(ids, "binary")
    tail = b"" if end is None else _little([end])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True

        def slow(value: str) -> bytes:
            return _little(tokenizer.encode(value, add_special_tokens=False).ids)

        fast = _by_ranks(ranks) if ranks else slow
        for batch in batches:
            found = []
            for value in batch.column(0):
                whole = value.as_py() or ""
                found.append((fast if whole.isascii() or max(whole) < "\u0250" else slow)(whole) + tail)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=schema.names)

    return docs.select(quoted(text), *[quoted(c) for c in kept]).mapInArrow(work, schema)


def _by_ranks(path: str):
    import public_tokenizers
    import tiktoken

    held = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return lambda value: held.encode_to_numpy(value, disallowed_special=()).astype("<u4").tobytes()


def cut(tokenized: DataFrame, capacity: int = CAPACITY, ids: str = "ids") -> DataFrame:
    """One row per piece: the other columns, ``start``, ``length``, ``doc_tokens``, and ``ids`` of this piece alone.

    A text of any length gives as many pieces as it fills; an empty table gives none.
    """
    names = ("start", "length", "doc_tokens")
    kept = [c for c in tokenized.columns if c != ids and c.lower() not in names]
    tokens = (F.octet_length(quoted(ids)) / 4).cast("long")
    starts = F.when(tokens > 0, F.sequence(F.lit(0).cast("long"), tokens - 1, F.lit(capacity).cast("long")))
    rows = tokenized.select(*[quoted(c) for c in kept], quoted(ids), tokens.alias("doc_tokens"), F.explode(starts).alias("start"))
    length = F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start"))
    piece = F.substring(quoted(ids), (F.col("start") * 4 + 1).cast("int"), (length * 4).cast("int"))
    return rows.select(*[quoted(c) for c in kept], "start", length.alias("length"), "doc_tokens", piece.alias(ids))


class OpenSequences:
    """Sequences with room, in a segment tree whose leaves are remaining capacities."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, sequence: int, room: int) -> None:
        self.at[room].append(sequence)
        node = room + self.leaves
        while node:
            self.some[node] += 1
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the sequence with the least room that is enough."""
        some, node = self.some, length + self.leaves
        while not some[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # beyond the last leaf of this level
                return None
        while node < self.leaves:
            node <<= 1
            if not some[node]:
                node += 1
        room = node - self.leaves
        while node:
            some[node] -= 1
            node >>= 1
        return self.at[room].pop(), room


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces are taken in ``order``, which must be by decreasing length."""
    sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, count = OpenSequences(capacity), 0
    for piece in order.tolist():
        length = int(lengths[piece])
        if length == capacity:
            sequences[piece], offsets[piece] = count, 0
            count += 1
            continue
        found = tree.tightest(length)
        if found is None:
            found = (count, capacity)
            count += 1
        sequences[piece], offsets[piece] = found[0], capacity - found[1]
        if found[1] > length:
            tree.put(found[0], found[1] - length)
    return sequences, offsets


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; lengths must be from 1 to ``capacity``.

    Offsets of a sequence are gapless from 0. The pieces are stored with a
    number each; groups are dealt by a hash of the whole row, and ties of
    length are taken in the order of that hash, so a task that runs again packs
    the same way. Only numbers and lengths go into the groups; their places are
    joined back, so wide rows never meet in a group. An empty table gives no
    rows. Columns of the input with a result's name are replaced.
    """
    prepared(pieces.sparkSession)
    pieces = pieces.select(*[quoted(c) for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    number, place = free_name(pieces.columns, "number"), [*pieces.columns, "sequence_id", "offset"]
    numbered = pieces.select("*", F.monotonically_increasing_id().alias(number))
    mark = F.xxhash64(*[quoted(c) for c in pieces.columns])
    kept = stored(numbered.withColumn(free_name(numbered.columns, "mark"), mark), "packing-pieces")
    mark = kept.columns[-1]
    groups = max(1, -(-kept.count() // GROUP_PIECES))
    narrow = kept.select(quoted(number).alias("number"), quoted(mark).alias("mark"), quoted(length).cast("long").alias("length"))
    dealt = narrow.withColumn("group", F.pmod(F.xxhash64("mark"), F.lit(groups).cast("long")))

    def work(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["number"].to_numpy(), table["mark"].to_numpy(), -lengths))
        sequences, offsets = best_fit(lengths, order, capacity)
        base = int(table["group"][0].as_py()) << 32
        return pa.table({"number": table["number"], "sequence_id": sequences + base, "offset": offsets})

    placed = by_group(dealt, ["group"], work, "number long, sequence_id long, offset long")
    joined = kept.join(placed.withColumnRenamed("number", number), number)
    return joined.select(*[quoted(c) for c in place])
