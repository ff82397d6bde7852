"""Conversation structure repair: the cheapest edits that turn a conversation into pairs of user and assistant turns.

Edits are the paths of a small graph: one layer of four states (nothing yet, a
system turn, a user turn, an assistant turn last) after each row. A path's
weight is one big integer. Its high digits hold the cost, its low digits, of
fixed width, the letters of its edits from the first to the last, with zeros
where the path has no more letters. So the least integer is the cheapest path
and, among equals, the one whose letters come first in ASCII order: taking the
least of integers decides everything.

Between two rows at most two turns are inserted (more would lead back to a
state at a higher cost), and inserts belong to the row that follows. Hence two
paths over the same rows never differ by letters at the end only, and a prefix
of the best path is the best to its state. Every ``BLOCK`` rows the letters
that are behind are replaced by their rank among the four states, which is all
that later comparisons need of them; so the integers stay short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import prepared

#: What an edit costs; a truncated row that stays costs one more.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 2, 3, 2, 1
#: Letters as digits, in ASCII order; 0 is the padding.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {digit: letter for letter, digit in DIGIT.items()}
BITS = 3
#: Rows after which letters are replaced by their rank; a row takes three letters at most.
BLOCK = 64
WIDTH = 3 * BLOCK + 2
#: Digits from high to low: cost, rank of the letters behind, letters of the block.
RANK_SHIFT = BITS * WIDTH
COST_SHIFT = RANK_SHIFT + 2

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an initial, where the order of roles allows it.
AFTER = {
    (NOTHING, "s"): SYSTEM,
    (NOTHING, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
#: The one role that may be written or inserted in a state.
NEXT_ROLE = {NOTHING: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}


class _Path:
    """The best edits so far that end in a state: weight, letters of this block, what was before, and the digest."""

    __slots__ = ("weight", "count", "behind", "digest", "some")

    def __init__(self, weight: int, count: int, behind: tuple | None, digest, some: bool):
        self.weight, self.count, self.behind, self.digest, self.some = weight, count, behind, digest, some

    def letters(self) -> str:
        return "".join(LETTER[(self.weight >> BITS * (WIDTH - 1 - at)) & ((1 << BITS) - 1)] for at in range(self.count))


def _step(cost: int, letter: str, at: int) -> int:
    return (cost << COST_SHIFT) + (DIGIT[letter] << BITS * (WIDTH - 1 - at))


class Repair:
    """The edits of one conversation, fed row by row in order; ``finish`` gives cost, letters and SHA-256 of the result.

    The rows themselves are not kept: each of the four paths carries its own
    digest of the repaired ``role:text`` lines.
    """

    def __init__(self) -> None:
        self.paths: dict[int, _Path] = {NOTHING: _Path(0, 0, None, hashlib.sha256(), False)}
        self.rows = 0

    def _ways(self, state: int, path: _Path, inserts: int) -> Iterator[tuple[int, int, int, int]]:
        """State, weight, letters and inserted turns after up to so many inserts."""
        weight, count = path.weight, path.count
        yield state, weight, count, 0
        for number in range(1, inserts + 1):
            weight += _step(INSERT, "I", count)
            count += 1
            state = USER if NEXT_ROLE[state] == "user" else ASSISTANT
            yield state, weight, count, number

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple[int, int, int, int, str | None]] = {}
        stays = STAYS_TRUNCATED if truncated else 0
        for start, path in self.paths.items():
            for state, weight, count, inserted in self._ways(start, path, 2):
                moves = [(state, DELETE, "D", None)]
                if not must_go:
                    kept = AFTER.get((state, role[:1]))
                    if kept is not None:
                        moves.append((kept, stays, "K", role))
                    written = NEXT_ROLE[state]
                    moves.append((AFTER[state, written[0]], REROLE + stays, "R", written))
                for end, cost, letter, line in moves:
                    total = weight + _step(cost, letter, count)
                    if end not in best or total < best[end][0]:
                        best[end] = (total, count + 1, start, inserted, line)
        self.paths = {
            end: self._moved(total, count, start, inserted, None if line is None else f"{line}:{text}")
            for end, (total, count, start, inserted, line) in best.items()
        }
        self.rows += 1
        if self.rows % BLOCK == 0:
            self._rank()

    def _moved(self, weight: int, count: int, start: int, inserted: int, line: str | None) -> _Path:
        path = self.paths[start]
        digest, some, state = path.digest.copy(), path.some, start
        for _ in range(inserted):
            role = NEXT_ROLE[state]
            digest.update((("\n" if some else "") + role + ":").encode())
            some, state = True, USER if role == "user" else ASSISTANT
        if line is not None:
            digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
            some = True
        return _Path(weight, count, path.behind, digest, some)

    def _rank(self) -> None:
        """Put the letters of the block behind, and start the next one with their rank."""
        letters = (1 << COST_SHIFT) - 1
        order = sorted(path.weight & letters for path in self.paths.values())
        for path in self.paths.values():
            path.behind = (path.behind, path.letters())
            path.weight = (path.weight >> COST_SHIFT << COST_SHIFT) + (order.index(path.weight & letters) << RANK_SHIFT)
            path.count = 0

    def finish(self) -> tuple[int, str, str]:
        ends = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
        best = None
        for start, path in self.paths.items():
            *_, (state, weight, count, inserted) = self._ways(start, path, ends[start])
            if best is None or weight < best[0]:
                best = (weight, count, start, inserted)
        path = self._moved(*best, None)
        parts, behind = [path.letters()], path.behind
        while behind is not None:
            behind, letters = behind
            parts.append(letters)
        return path.weight >> COST_SHIFT, "".join(reversed(parts)), path.digest.hexdigest()


BLANK = " \t\n\v\f\r"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
LONGEST = (1 << 63) - 1


class _Conversation:
    """Counts and repair of one conversation, row by row."""

    def __init__(self) -> None:
        self.repair = Repair()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first: int | None = None
        self.last: int | None = None
        self.before: tuple | None = None
        self.initial: str | None = None

    def row(self, turn: int | None, role: str, text: str, mark: tuple, seen: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.initial is not None and (self.initial, role[:1]) not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        end = text.rstrip(BLANK)
        # equal rows of one turn lie side by side
        seen = seen or (turn, mark) == self.before
        self.before = (turn, mark)
        blank, duplicate, truncated = not end, bool(end) and seen, bool(end) and not seen and end[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.row(role, text, blank or duplicate, truncated)

    def finish(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, LONGEST)
        cost, audit, digest = self.repair.finish()
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by CRC-32 of ``conv_id:turn`` modulo 20; ``copies`` says how often a row is there (0 to 2).

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of
    it, 3 repeats the row, 4 makes its role user. Nulls are one space, also in
    the key.
    """

    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` (null is one, too) of ``rows`` (conv_id, turn, role, text and, if given, copies).

    Rows are taken by turn, nulls first; rows of one turn by a 128-bit hash of
    role and text, so equal ones lie side by side. A row with 0 copies is not
    there, but its conversation is: one without any rows has zeros, an empty
    audit and the digest of nothing. Null roles and texts count as empty. Other
    columns are ignored; an empty table gives no rows.

    Which rows repeat an earlier one is counted over narrow keys first, so no
    conversation's rows are held. Then a task reads a conversation as a stream
    in order; its digest is one sequential hash, so a long conversation stays
    in one task, with memory for its audit letters and one row.
    """
    prepared(rows.sparkSession)
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("role", "text"))
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    source = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, copies.alias("copies"))
    marked = source.withColumns({"mark1": F.xxhash64("role", "text"), "mark2": F.xxhash64(F.lit(7), "text", "role")})
    same = ["conv_id", "mark1", "mark2"]
    found = marked.filter("copies > 0").groupBy(*same).agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("from_null"), F.max("turn").alias("last"))
    # a mark that occurs in one turn only needs no look back beyond the row before
    again = found.filter("first < last OR (from_null AND first IS NOT NULL)").select(*[F.col(c).alias(f"_{c}") for c in same], "first", "from_null")
    joined = marked.join(again, (F.col("mark1") == F.col("_mark1")) & (F.col("mark2") == F.col("_mark2")) & F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    seen = F.coalesce(F.col("turn").isNotNull() & (F.col("from_null") | (F.col("turn") > F.col("first"))), F.lit(False))
    dealt = joined.select(*marked.columns, seen.alias("seen")).repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "mark1", "mark2")
    return ordered.mapInArrow(_repaired, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FIELDS}")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", *[field.split()[0] for field in FIELDS.split(", ")]]
    kind, current, work, done = None, None, None, []

    def made() -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            conv, turn, role, text, copies, mark1, mark2, seen = row
            if work is None or conv != current:
                if work is not None:
                    done.append((current, *work.finish()))
                current, work = conv, _Conversation()
            for _ in range(copies):
                work.row(turn, role, text, (mark1, mark2), seen)
        if len(done) >= 1000:
            yield made()
            done = []
    if work is not None:
        done.append((current, *work.finish()))
        yield made()
