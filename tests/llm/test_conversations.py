"""Prefix trie and structure repair of conversations, against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from gaitworks.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, bytes string, seen int, n_convs int"


def table(spark, rows):
    """With columns besides the four that clash with names the operators use."""
    return spark.createDataFrame([(*row, 1, "x", 2, 3) for row in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- the trie


def conversations(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in found.items()}


def brute_trie(rows):
    original = conversations(rows)
    rebuilt = {}
    for conv, turns in original.items():
        h = zlib.crc32(str(conv).encode()) % 9
        head = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        rebuilt[conv] = original.get(head, [])[:h] + turns[h:]
    members, ended = defaultdict(list), defaultdict(list)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ended[tuple(turns)].append(conv)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    parents = {node[:-1] for node in members if node}
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    return sorted(
        (
            min(convs),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(convs),
            children[node],
            sum(x not in parents for x in below[node]),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below[node] if x),
            sha(",".join(map(str, sorted(ended[node])))),
        )
        for node, convs in members.items()
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(spark, rows):
    found = trie.prefix_trie(table(spark, rows))
    assert found.columns == NODE
    return sorted(tuple(r) for r in found.collect())


def random_rows(seed, convs, longest=14):
    draw, rows = random.Random(seed), []
    for conv in convs:
        for turn in range(draw.choice([1, 2, 3, 5, 9, longest])):
            # few texts, so that prefixes are shared; both depend on the turn most of the time
            text = draw.choice(["á", "b", None, ""]) if draw.random() < 0.2 else f"turn {turn}"
            rows.append((conv, turn if draw.random() < 0.95 else None, draw.choice(["user", "user", None]), text))
    # a turn that comes twice, with equal and with other words, is still a turn of its own
    rows += [rows[3], rows[5], *[(conv, 1, "user", "turn 1") for conv in convs[:3]], (None, 1, "user", "nobody's")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,span,bits", [(4, 1 << 12, 12), (1, 3, 1), (3, 2, 0)])
def test_trie_against_plain_python(spark, monkeypatch, block, span, bits):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "SPAN", span)
    monkeypatch.setattr(trie, "ID_BITS", bits)
    rows = [r for r in random_rows(block, [*range(-12, 25), 1 << 40, (1 << 40) + 3])]
    # rows of one turn come in the order of a hash, in plain Python by their words: keep turns apart
    seen, apart = set(), []
    for conv, turn, role, text in rows:
        if (conv, turn) not in seen:
            seen.add((conv, turn))
            apart.append((conv, turn, role, text))
    assert nodes(spark, apart) == brute_trie(apart)


def test_equal_rows_of_one_turn_stay(spark):
    rows = [(0, 1, "user", "a"), (0, 1, "user", "a"), (0, None, "user", "b"), (0, None, "user", "b"), (5, 0, None, None)]
    assert nodes(spark, rows) == brute_trie(rows)


def test_rows_of_one_turn_have_one_order(spark):
    rows = [(0, 1, "user", x) for x in "abcdefgh"]
    assert nodes(spark, rows) == nodes(spark, rows[::-1])


def test_a_long_conversation_and_copies_of_it(spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 16)
    monkeypatch.setattr(trie, "ID_BITS", 2)
    long = [(turn, "user" if turn % 2 else "assistant", "long " * (turn % 3)) for turn in range(150)]
    rows = [(conv, *turn) for conv in (0, 5, 10, 15, 20) for turn in long[: 150 - conv]]
    rows += [(conv, 0, "user", "x" * 100_000) for conv in range(21, 60)]
    assert nodes(spark, rows) == brute_trie(rows)


def test_no_conversations(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 0, "user", "a")]) == []


def test_only_the_root_has_every_conversation(spark):
    # conversation 7 is left without turns: its head is not there, and it skips more turns than it has
    conv = next(c for c in range(6, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert nodes(spark, [(conv, 0, "user", "a")]) == [(conv, 0, None, 1, 0, 1, 0, sha(str(conv)))]


# ---------------------------------------------------------------- the repair


def cheapest(rows):
    """Cost, audit and digest by searching edits in the order of cost and letters."""
    heap, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, sha("\n".join(lines))
        if (at, audit, initials) in seen or not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        seen.add((at, audit, initials))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, initials + role[0], (*lines, f"{role}:")))
        if at < len(rows):
            role, text, must_go, truncated = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, initials, lines))
            if not must_go:
                heapq.heappush(heap, (cost + truncated, audit + "K", at + 1, initials + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + truncated, audit + "R", at + 1, initials + new[0], (*lines, f"{new}:{text}")))


@pytest.mark.parametrize("block", [64, 1, 2, 3])
def test_the_least_integer_is_the_cheapest_path(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    draw = random.Random(block)
    for _ in range(150):
        rows = [(draw.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", draw.random() < 0.2, draw.random() < 0.3) for i in range(draw.randrange(7))]
        work = repair.Repair()
        for row in rows:
            work.row(*row)
        assert work.finish() == cheapest(rows)


def test_blocks_make_no_difference_for_long_conversations(monkeypatch):
    draw = random.Random(8)
    rows = [(draw.choice(["user", "assistant", "system", "x"]), "t", draw.random() < 0.1, draw.random() < 0.3) for _ in range(60)]
    found = []
    for block in (64, 2, 7):
        monkeypatch.setattr(repair, "BLOCK", block)
        work = repair.Repair()
        for row in rows:
            work.row(*row)
        found.append(work.finish())
    assert found[0] == found[1] == found[2]


def test_weights_stay_short():
    work = repair.Repair()
    for i in range(5000):
        work.row("x", "t", i % 7 == 0, i % 3 == 0)
    assert max(path.weight for path in work.paths.values()).bit_length() < repair.COST_SHIFT + 20


def brute_repair(rows):
    every = {row[0] for row in rows}
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept[conv] += [(turn is not None, turn or 0, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    found = {}
    for conv in every:
        turns, seen, edits, counts = sorted(kept[conv]), set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            edits.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [t[1] for t in turns if t[0]]
        initials = [t[2][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        found[conv] = (gaps, *counts.values(), illegal, *cheapest(edits))
    return found


def repaired(spark, rows):
    found = repair.repair(repair.damaged(table(spark, rows)))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in found.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def test_repair_against_plain_python(spark):
    draw, rows = random.Random(4), []
    texts = ["one.", "two", "three! \t", " \x0b", "", None, "four? ", "é.", "five\x1f", "one."]
    for conv in [*range(60), -3, None]:
        turns = draw.sample([None, *range(9)], draw.randint(1, 7))
        rows += [(conv, turn, draw.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""]), draw.choice(texts)) for turn in turns]
    draw.shuffle(rows)
    assert repaired(spark, rows) == brute_repair(rows)


def test_repeated_rows_and_turns_far_apart(spark):
    rows = [(1, 5, "user", "a."), (1, 5, "user", "a."), (1, -(1 << 63), "user", "b."), (1, (1 << 63) - 1, "user", "c.")]
    found = repaired(spark, rows)[1]
    assert found[0] == repair.LONGEST and found[2] >= 1


def test_conversations_without_rows_after_the_damage(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(conv, 0, "user", "a.")]) == {conv: (0, 0, 0, 0, 0, 0, "", sha(""))}
    assert repaired(spark, []) == {}


def test_a_long_conversation_is_repaired(spark):
    rows = [(3, turn, "user" if turn % 2 == 0 else "assistant", f"word {turn}." * 50) for turn in range(3000)]
    found = repaired(spark, rows)[3]
    lines = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        lines += [role] * (fault != 0)
    assert found[2] == sum(zlib.crc32(f"3:{t}".encode()) % 20 == 3 for t in range(3000))
    assert len(found[6]) >= len(lines)


def test_repair_without_copies_takes_rows_as_they_are(spark):
    rows = spark.createDataFrame([(1, 0, "system", "x."), (1, 1, "user", "y."), (1, 2, "assistant", "z")], "conv_id int, turn int, role string, text string")
    assert tuple(repair.repair(rows).first())[1:8] == (0, 0, 0, 1, 0, 1, "KKK")
