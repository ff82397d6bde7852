"""Byte-level BPE encoding with a rank queue, and decoding.

A pre-token's bytes form a linked list. Each neighbouring pair that has a rank
lies in that rank's bucket; a bitmap of two levels over the ranks tells by
find-first-set which bucket is next, whatever the length of the list. An entry
is stale, and skipped, if its pair is no longer what it was when it was put in.
Merging takes time in proportion to the number of merges, so a pre-token of
millions of bytes is fine.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gaitworks.llm.common import prepared, quoted, slices
from gaitworks.llm.units import careful_units, quick_units, sound

#: Texts that share a queue, in bytes.
SLICE = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Ranks in a block of the bitmap: one bit each, and in the top level one bit for each block.
_BLOCK_BITS = 8
_LAST = (1 << _BLOCK_BITS) - 1
#: Entries that are sorted by rank as one array; fewer go to their buckets one by one.
_MANY = 48


class RankQueue:
    """List positions in buckets by rank; the bucket of the least rank first."""

    def __init__(self) -> None:
        self.top, self.low = 0, {}
        self.buckets: dict[int, list[int]] = {}

    def put(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if len(ranks) < _MANY:
            for rank, position in zip(ranks.tolist(), positions.tolist()):
                held = self.buckets.get(rank)
                if held is None:
                    self._open(rank, [position])
                else:
                    held.append(position)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order].tolist()
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(positions)]
        for start, stop, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
            held = self.buckets.get(rank)
            if held is None:
                self._open(rank, positions[start:stop])
            else:
                held += positions[start:stop]

    def _open(self, rank: int, positions: list[int]) -> None:
        self.buckets[rank] = positions
        block = rank >> _BLOCK_BITS
        self.low[block] = self.low.get(block, 0) | 1 << (rank & _LAST)
        self.top |= 1 << block

    def take(self) -> tuple[int, list[int]] | None:
        """The least rank that has a bucket, found by the first set bit of both levels, and the bucket."""
        if not self.top:
            return None
        block = (self.top & -self.top).bit_length() - 1
        bits = self.low[block]
        first = bits & -bits
        bits ^= first
        if bits:
            self.low[block] = bits
        else:
            del self.low[block]
            self.top &= self.top - 1
        rank = (block << _BLOCK_BITS) + first.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Merges:
    """The rank of every two tokens that make a third, as sorted arrays by left and by right token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes((i,))] for i in range(256)], np.int64)
        found = [
            (left, right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        table = np.array(found, np.int64).reshape(-1, 3)
        size = max(ranks.values()) + 2
        self._by_left = self._sorted(table[:, 0], table[:, 1], table[:, 2], size)
        self._by_right = self._sorted(table[:, 1], table[:, 0], table[:, 2], size)
        self._pairs: dict[tuple[int, int], int] | None = None
        self.pairs = np.full(65536, -1, np.int64)
        place = {rank: i for i, rank in enumerate(self.bytes.tolist())}
        for left, right, rank in found:
            if left in place and right in place:
                self.pairs[place[left] << 8 | place[right]] = rank

    @staticmethod
    def _sorted(first: np.ndarray, second: np.ndarray, rank: np.ndarray, size: int):
        order = np.lexsort((second, first))
        return np.searchsorted(first[order], np.arange(size + 1)).tolist(), second[order], rank[order]

    @staticmethod
    def _find(table, token: int, others: np.ndarray) -> np.ndarray:
        starts, second, rank = table
        start, stop = starts[token], starts[token + 1]
        if start == stop:
            return np.full(len(others), -1, np.int64)
        near = second[start:stop]
        at = np.minimum(np.searchsorted(near, others), stop - start - 1)
        return np.where(near[at] == others, rank[start:stop][at], -1)

    def by_pair(self) -> dict[tuple[int, int], int]:
        if self._pairs is None:
            starts, second, rank = self._by_left
            left = np.repeat(np.arange(len(starts) - 1), np.diff(starts)).tolist()
            self._pairs = dict(zip(zip(left, second.tolist()), rank.tolist()))
        return self._pairs

    def after(self, token: int, others: np.ndarray) -> np.ndarray:
        return self._find(self._by_left, token, others)

    def before(self, token: int, others: np.ndarray) -> np.ndarray:
        return self._find(self._by_right, token, others)


def merge(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pre-tokens, one after the other, and where those of each begin.

    In each pre-token, again and again the leftmost pair of the least rank is
    merged. All pre-tokens lie end to end in one linked list and share one
    queue, so that a bucket's entries are taken together: of each pre-token the
    leftmost one that is not stale; what it has further on goes back into the
    bucket, as the merge may have made a pair that comes first.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    size = len(data)
    lengths = np.array([len(piece) for piece in pieces], np.int64)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    edge = np.ones(size + 1, bool)
    edge[1:size] = owner[1:] != owner[:-1]
    # parts of the list are known by where they start
    ids, end, before = merges.bytes[data], np.arange(1, size + 1), np.arange(-1, size)
    alive = np.ones(size, bool)
    rank_at = np.full(size, -1, np.int64)
    inner = np.flatnonzero(~edge[1:])
    rank_at[inner] = merges.pairs[data[inner] << 8 | data[inner + 1]]
    queue = RankQueue()
    some = np.flatnonzero(rank_at >= 0)
    queue.put(rank_at[some], some)
    while (taken := queue.take()) is not None:
        rank, bucket = taken
        at = np.array(bucket)
        at = at[rank_at[at] == rank]
        if len(at) > 1:
            at.sort()
            whose = owner[at]
            first = np.empty(len(at), bool)
            first[0] = True
            np.not_equal(whose[1:], whose[:-1], out=first[1:])
            if not first.all():
                rest = at[~first]
                queue.put(np.full(len(rest), rank), rest)
                at = at[first]
        elif not len(at):
            continue
        middle = end[at]
        stop = end[middle]
        ids[at], end[at] = rank, stop
        alive[middle] = False
        rank_at[middle] = -1
        rank_at[at] = -1
        inside = np.flatnonzero(~edge[stop])
        if len(inside):
            here, next_ = at[inside], stop[inside]
            before[next_] = here
            found = merges.after(rank, ids[next_])
            rank_at[here] = found
            some = np.flatnonzero(found >= 0)
            if len(some):
                queue.put(found[some], here[some])
        inside = np.flatnonzero(~edge[at])
        if len(inside):
            earlier = before[at[inside]]
            found = merges.before(rank, ids[earlier])
            rank_at[earlier] = found
            some = np.flatnonzero(found >= 0)
            if len(some):
                queue.put(found[some], earlier[some])
    counts = np.bincount(owner[alive], minlength=len(pieces))
    return ids[alive], np.concatenate(([0], np.cumsum(counts)))


def merge_long(piece: bytes, merges: Merges) -> np.ndarray:
    """The ids of one long pre-token, with a queue of its own, one merge at a time.

    Its buckets may hold very many entries that touch each other, which
    ``merge`` would put back again and again.
    """
    size = len(piece)
    ids = merges.bytes[np.frombuffer(piece, np.uint8)].tolist()
    end, before = list(range(1, size + 1)), list(range(-1, size))
    data = np.frombuffer(piece, np.uint8).astype(np.int64)
    first = merges.pairs[data[:-1] << 8 | data[1:]]
    rank_at = [*first.tolist(), -1]
    queue = RankQueue()
    some = np.flatnonzero(first >= 0)
    queue.put(first[some], some)
    buckets, known = queue.buckets, merges.by_pair()
    while (taken := queue.take()) is not None:
        rank, bucket = taken
        bucket.sort()
        for place, at in enumerate(bucket):
            if rank_at[at] != rank:
                continue  # stale: the pair that was put in is no more
            middle = end[at]
            stop = end[middle]
            ids[at], end[at], rank_at[middle], rank_at[at] = rank, stop, -1, -1
            lowest = rank + 1
            if stop < size:
                before[stop] = at
                found = rank_at[at] = known.get((rank, ids[stop]), -1)
                if found >= 0:
                    lowest = min(lowest, found)
                    if found in buckets:
                        buckets[found].append(at)
                    else:
                        queue._open(found, [at])
            earlier = before[at]
            if earlier >= 0:
                found = rank_at[earlier] = known.get((ids[earlier], rank), -1)
                if found >= 0:
                    lowest = min(lowest, found)
                    if found in buckets:
                        buckets[found].append(earlier)
                    else:
                        queue._open(found, [earlier])
            if lowest <= rank:
                # a new pair comes before the rest of this bucket, which goes back
                rest = bucket[place + 1 :]
                if rest:
                    if rank in buckets:
                        buckets[rank] += rest
                    else:
                        queue._open(rank, rest)
                break
    out, at = [], 0
    while at < size:
        out.append(ids[at])
        at = end[at]
    return np.array(out, np.int64)


#: Encodings of units that a task keeps, and the longest unit kept; a full store starts anew.
KEPT, LONGEST = 400_000, 48
#: Pre-tokens up to this many bytes share a queue with others; a longer one has its own.
SHARED = 64


class Encoder:
    """Ids of whole texts as native 32-bit values; what units have in common is encoded once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.merges, self.split = ranks, Merges(ranks), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [quick_units(text) for text in texts]
        if len(self.known) > KEPT:
            self.known = {}
        known = self.known
        fresh = {unit for part in cut for unit in part if unit not in known}
        unsound = {unit for unit in fresh if not sound(unit)}
        if unsound:
            cut = [part if unsound.isdisjoint(part) else careful_units(text) for text, part in zip(texts, cut)]
            fresh = {unit for part in cut for unit in part if unit not in known}
        new = list(fresh)
        pieces = [self.split(unit) for unit in new]
        words = list({piece for part in pieces for piece in part})
        made: dict[str, bytes] = {}
        merged: list[str] = []
        whole: list[bytes] = []
        for word in words:
            piece = word.encode()
            rank = self.ranks.get(piece)
            if rank is not None:
                made[word] = array("i", (rank,)).tobytes()
            elif len(piece) <= SHARED:
                merged.append(word)
                whole.append(piece)
            else:
                made[word] = merge_long(piece, self.merges).astype(np.int32).tobytes()
        if merged:
            ids, starts = merge(whole, self.merges)
            data, bounds = ids.astype(np.int32).tobytes(), (starts * 4).tolist()
            for word, start, stop in zip(merged, bounds, bounds[1:]):
                made[word] = data[start:stop]
        long: dict[str, bytes] = {}
        for unit, part in zip(new, pieces):
            (known if len(unit) <= LONGEST else long)[unit] = made[part[0]] if len(part) == 1 else b"".join([made[p] for p in part])
        if not long:
            return [b"".join([known[unit] for unit in part]) for part in cut]
        return [b"".join([known[unit] if unit in known else long[unit] for unit in part]) for part in cut]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Every row with ``ids``: the tokens of the whole text, no special ones among them.

    ``vocabulary`` is the path of a rank file on every worker. Null text is
    empty, a text of any length is taken whole, an empty table gives no rows. A
    column of the input that is named ``ids`` is replaced.
    """
    prepared(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != ids.lower()]
    schema = docs.select(*[quoted(c) for c in kept]).schema.add(ids, T.ArrayType(T.IntegerType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(vocabulary), pattern)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                found = encoder.encode([value.as_py() or "" for value in part.column(0)])
                offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], column], names=schema.names)

    return docs.select(quoted(text), *[quoted(c) for c in kept]).mapInArrow(work, schema)


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the bytes of its ids. Null ids have none; an id without a token is an error; an empty table stays empty."""
    prepared(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != decoded.lower()]
    schema = docs.select(*[quoted(c) for c in kept]).schema.add(decoded, "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(vocabulary)
        tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        for batch in batches:
            lists = batch.column(0)
            found = [b"".join(map(tokens.__getitem__, lists[i].values.to_numpy().tolist() if lists[i].is_valid else ())) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.binary())], names=schema.names)

    return docs.select(quoted(ids), *[quoted(c) for c in kept]).mapInArrow(work, schema)
