"""Substring dedup on words and suffix-array dedup on bytes, against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from gaitworks.llm import induced, runs, substring, suffix
from gaitworks.llm.common import string_bytes, word_hashes

SCHEMA = "doc_id long, text string, k1 string, n_words int, spans int"


def texts():
    draw = random.Random(5)
    words = ["ab", "cé", "d", "é", "fg　h", "x" * 30, "\x1fq"]
    passage = [draw.choice(words) for _ in range(60)]
    found = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 90))) for _ in range(20)]
    found += [" ".join(found[3].split(" ")[:20] + passage[:n] + found[4].split(" ")[:30]) for n in (5, 30, 31, 60)]
    found += [found[0], found[0], "", None, "same " * 300, "\t\n one \x0b\x0ctwo\r", " ".join(passage) * 50, "a" * 5000]
    return found


def rows(spark, values):
    return spark.createDataFrame([(i if i % 7 else None, t, "other", 3, 4) for i, t in enumerate(values)], SCHEMA)


def words_kept(values, window):
    lists = [(t or "").encode().split() for t in values]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((b" ".join(x for i, x in enumerate(w) if i not in gone).decode(), len(w), len(gone)))
    return out


def bytes_kept(values, window):
    lists = [(t or "").encode() for t in values]
    seen = Counter(b[i : i + window] for b in lists for i in range(len(b) - window + 1))
    out = []
    for b in lists:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((bytes(np.frombuffer(b, np.uint8)[~gone]), len(b), int(gone.sum()), spans))
    return out


@pytest.mark.parametrize("window,gram", [(35, 8), (6, 2), (3, 3)])
def test_words_against_plain_python(spark, window, gram):
    values = texts()
    found = substring.remove_repeated(rows(spark, values), "text", window, gram)
    assert found.columns == ["doc_id", "text", "k1", "spans", "kept", "n_words", "n_removed", "n_spans"]
    got = Counter((r["kept"], r["n_words"], r["n_removed"]) for r in found.collect())
    assert got == Counter(words_kept(values, window))


@pytest.mark.parametrize("window,gram", [(400, 32), (40, 8), (9, 4)])
def test_bytes_against_plain_python(spark, window, gram, monkeypatch):
    values = texts()
    found = suffix.remove_repeated(rows(spark, values), "text", window, gram)
    got = Counter((bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found.collect())
    assert got == Counter(bytes_kept(values, window))


def test_an_anchor_with_many_runs_is_dealt_to_pairs_of_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_RUNS", 3)
    draw = random.Random(2)
    middle = "m" * 3 + "anchoranchor" + "n" * 3
    values = ["".join(draw.choice("uvw") for _ in range(draw.randint(0, 6))) + middle + "".join(draw.choice("xyz") for _ in range(6)) for _ in range(60)]
    found = suffix.remove_repeated(rows(spark, values), "text", 20, 5)
    got = Counter((bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found.collect())
    assert got == Counter(bytes_kept(values, 20))


@pytest.mark.parametrize("operator", [substring.remove_repeated, suffix.remove_repeated])
def test_an_empty_table_gives_no_rows(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_are_worked_through_in_passes(monkeypatch):
    data = np.frombuffer((" ".join(random.Random(1).choice(["a", "bb", "c"]) for _ in range(4000))).encode(), np.uint8)
    whole, _ = word_hashes(data, np.array([0, len(data)]))
    import gaitworks.llm.common as common

    monkeypatch.setattr(common, "_LONG", 100)
    again, places = word_hashes(data, np.array([0, len(data)]))
    assert (whole == again).all() and places.tolist() == [0, len(whole)]
    once = runs.window_runs(whole, np.array([0, len(whole)]), 9, 3)
    monkeypatch.setattr(runs, "_PASS", 64)
    parts = runs.window_runs(whole, np.array([0, len(whole)]), 9, 3)
    cover = lambda found: sorted(int(s) + i for s, n in zip(found[1], found[2]) for i in range(int(n)))
    assert cover(once) == cover(parts) == list(range(len(whole) - 8))


def test_words_of_texts_laid_end_to_end_do_not_join():
    import pyarrow as pa

    column = pa.array(["ab", "cd ef", None, "", " g\x0bh "])
    words, places = word_hashes(*string_bytes(column))
    assert np.diff(places).tolist() == [1, 2, 0, 0, 2]
    assert words[0] == word_hashes(np.frombuffer(b"x ab", np.uint8), np.array([0, 4]))[0][1]


@pytest.mark.parametrize("small", [0, 1024])
def test_suffix_arrays_and_prefixes_against_sorting(small, monkeypatch):
    monkeypatch.setattr(induced, "SMALL_ALPHABET", small)
    draw = random.Random(9)
    for _ in range(300):
        n, k = draw.randint(1, 40), draw.choice([1, 2, 3, 300])
        s = [draw.randint(1, k) for _ in range(n)]
        s = np.array((s * draw.choice([1, 1, 3])) + [0])
        array = induced.suffix_array(s)
        listed = s.tolist()
        assert array.tolist() == sorted(range(len(listed)), key=lambda i: listed[i:])
        before, after = induced.common_prefixes(s, array)
        for rank, (i, j) in enumerate(zip(array[:-1].tolist(), array[1:].tolist())):
            common = 0
            while i + common < len(s) and j + common < len(s) and s[i + common] == s[j + common]:
                common += 1
            assert before[j] == after[i] == common
        assert before[array[0]] == 0 and after[array[-1]] == 0
