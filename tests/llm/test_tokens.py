"""Units, byte-level BPE and packing, against the tokenizer libraries and plain Python."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaitworks.llm import bpe, packing
from gaitworks.llm.units import units

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")
ODD = "".join(["ab ", "  ", "\n", " \n ", "\n\n", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "'s", "é", "\u4e2d\u6587", "12", "!?", "\x00", "\U0001f600", "A"])


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PLAIN)
    found.encode_special_tokens = True
    return found


def odd_texts():
    draw = random.Random(3)
    parts = ["ab", " ", "  ", "\n", " \n ", "\n\n", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "'s", "é", "中文", "12", "!?", "\x00", "😀", "<|endoftext|>"]
    found = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(300)]
    return found + ["", None, "x" * 20000, " " * 3000, "ab" * 5000 + " end", "the cat sat on the mat\nagain and again"]


def test_units_join_to_the_text():
    for text in odd_texts():
        assert "".join(units(text or "")) == (text or "")


def test_the_store_stays_bounded(monkeypatch, tiktoken_encoding):
    monkeypatch.setattr(bpe, "KEPT", 30)
    monkeypatch.setattr(bpe, "LONGEST", 6)
    encoder = bpe.Encoder(_ranks(), public_tokenizers.PATTERN)
    for text in odd_texts():
        ids = np.frombuffer(encoder.encode([text or "", "some more words"])[0], np.int32).tolist()
        assert ids == tiktoken_encoding.encode_ordinary(text or "")
        assert len(encoder.known) <= 100 and all(len(unit) <= 6 for unit in encoder.known)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ODD + "abehnort .,", max_size=40))
def test_merging_equals_the_library(text):
    import regex
    import tiktoken

    ranks = _ranks()
    encoding = _cached.setdefault("encoding", None) or _cached.__setitem__(
        "encoding", tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ) or _cached["encoding"]
    pieces = [piece.encode() for unit in units(text) for piece in regex.findall(public_tokenizers.PATTERN, unit)]
    known = [ranks.get(piece) for piece in pieces]
    alone = [[rank] if rank is not None else bpe.merge_long(piece, _merges()).tolist() for rank, piece in zip(known, pieces)]
    assert [i for ids in alone for i in ids] == encoding.encode_ordinary(text)
    ids, starts = bpe.merge(pieces, _merges())
    together = [ids[a:b].tolist() if rank is None else [rank] for rank, a, b in zip(known, starts, starts[1:])]
    assert together == alone


_cached: dict = {}


def _ranks():
    if "ranks" not in _cached:
        _cached["ranks"] = bpe.read_ranks(MULTI)
    return _cached["ranks"]


def _merges():
    if "merges" not in _cached:
        _cached["merges"] = bpe.Merges(_ranks())
    return _cached["merges"]


def test_merging_by_made_up_ranks():
    """Ranks in any order, so that a merge can make a pair that comes before the rest of its bucket."""
    draw = random.Random(8)
    for _ in range(400):
        together, wanted = [], []
        tokens = [bytes([c]) for c in range(256)]
        while len(tokens) < 265:
            able = [*tokens[97:100], *tokens[256:]]
            made = draw.choice(able) + draw.choice(able)
            if made not in tokens:
                tokens.append(made)
        order = tokens[256:]
        draw.shuffle(order)
        ranks = {token: rank for rank, token in enumerate(tokens[:256] + order)}
        for _ in range(6):
            piece = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 14)))
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                least = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 999), i))
                if parts[least] + parts[least + 1] not in ranks:
                    break
                parts[least : least + 2] = [parts[least] + parts[least + 1]]
            together.append(piece)
            wanted.append([ranks[p] for p in parts])
        merges = bpe.Merges(ranks)
        ids, starts = bpe.merge(together, merges)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == wanted
        assert [bpe.merge_long(piece, merges).tolist() for piece in together] == wanted


def test_a_very_long_pre_token(tiktoken_encoding):
    text = "".join(random.Random(2).choice("abcé") for _ in range(60000))
    assert bpe.merge_long(text.encode(), _merges()).tolist() == tiktoken_encoding.encode_ordinary(text)


def test_encode_and_decode(spark, tiktoken_encoding):
    values = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(values)], "doc_id long, text string, ids string, decoded int")
    found = bpe.decode(bpe.encode(docs, MULTI, public_tokenizers.PATTERN), MULTI)
    assert found.columns == ["doc_id", "text", "ids", "decoded"]
    for row in found.collect():
        text = values[row["doc_id"]] or ""
        assert row["ids"] == tiktoken_encoding.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()
    assert bpe.decode(bpe.encode(docs.limit(0), MULTI, public_tokenizers.PATTERN), MULTI).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(nothing, MULTI).collect()] == [b"", b""]


def test_packing_round_trip(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 100)
    values = odd_texts() + ["the cat"] * 3
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(values)], "doc_id long, text string, start int, sequence_id int")
    pieces = packing.pack(packing.cut(packing.tokenize(docs, PLAIN, RANKS), 256), capacity=256)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(values)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        part = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert part == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]] and len(part) == r["length"] <= 256
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, whole in ids.items():
        assert sum(n for _, n in by_doc[i]) == len(whole) and len({s for s, _ in by_doc[i]}) == len(by_doc[i])
    for parts in by_sequence.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 256
    assert packing.pack(packing.cut(packing.tokenize(docs.limit(0), PLAIN))).count() == 0


def test_digests_in_the_engine_equal_the_library(spark, tokenizer):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    row = packing.cut(packing.tokenize(docs, PLAIN)).select(F.crc32("ids").alias("c")).first()
    ids = tokenizer.encode("some text here", add_special_tokens=False).ids + [1]
    assert row["c"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_best_fit_takes_the_tightest():
    draw = random.Random(4)
    lengths = np.array([draw.randint(1, 50) for _ in range(400)])
    order = np.argsort(-lengths, kind="stable")
    sequences, offsets = packing.best_fit(lengths, order, 50)
    rooms: list[int] = []
    for piece in order:
        able = [(room, i) for i, room in enumerate(rooms) if room >= lengths[piece]]
        if able:
            room = min(able)[0]
            assert 50 - offsets[piece] == room
            rooms[sequences[piece]] -= lengths[piece]
        else:
            assert sequences[piece] == len(rooms) and offsets[piece] == 0
            rooms.append(50 - int(lengths[piece]))
        assert rooms[sequences[piece]] >= 0


def test_read_ranks(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a b") + b" 7\n")
    assert bpe.read_ranks(str(path)) == {b"a b": 7}
