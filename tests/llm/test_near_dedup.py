"""Near-dedup of texts and vectors, and components, against plain Python."""

import itertools
import random

import numpy as np
import pytest

from gaitworks.llm import minhash, vectors
from gaitworks.llm.components import components


def least_reachable(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("shape", ["path", "star", "random", "loops"])
def test_components_against_plain_python(spark, shape):
    draw = random.Random(3)
    links = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(99, i) for i in range(60)],
        "random": [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(50)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[shape]
    expected = least_reachable({x for link in links if link[0] != link[1] for x in link}, [x for x in links if x[0] != x[1]])
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == expected


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    folded = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = folded.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def texts():
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [draw.choice(vocabulary) for _ in range(200)]
    found = []
    for _ in range(60):
        copy = list(base)
        for _ in range(draw.randint(0, 12)):
            copy[draw.randrange(200)] = draw.choice(vocabulary)
        found.append(" ".join(copy))
    found += [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 40))) for _ in range(40)]
    found += [found[0].upper(), found[5], found[5], "", None, "  \t ", "one two", "One  TWO", "one two three", "É a b c d", "é a b c d"]
    return found


def expected_groups(values, ids, percent):
    sets = [shingles(t) for t in values]
    links = []
    for a, b in itertools.combinations(range(len(values)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            links.append((a, b))
    groups = least_reachable(range(len(values)), links)
    members = {}
    for row, group in groups.items():
        members.setdefault(group, []).append(ids[row])
    return [min(members[groups[row]]) for row in range(len(values))], [len(s) for s in sets]


@pytest.mark.parametrize("percent,block", [(85, 512), (85, 7), (92, 512)])
def test_texts_against_plain_python(spark, monkeypatch, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    values = texts()
    ids = random.Random(1).sample(range(1000), len(values))
    docs = spark.createDataFrame([(i, t, 6, 7, 8) for i, t in zip(ids, values)], "doc_id long, text string, n int, kept int, k1 int")
    found = minhash.near_duplicates(docs, percent=percent)
    assert found.columns == ["doc_id", "text", "n", "k1", "n_shingles", "component_id", "kept"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()}
    component, sizes = expected_groups(values, ids, percent)
    assert got == {i: (n, c, i == c) for i, n, c in zip(ids, sizes, component)}


def test_one_representative_of_each_group_whatever_the_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (1, long + " more"), (None, long), (None, "a b c d e f"), (None, "a b c d e f"), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r["component_id"] for r in found if r["text"] and r["text"].startswith("w0")} == {1}
    kept = sorted((r["doc_id"] or -1, (r["text"] or "")[:5]) for r in minhash.representatives(docs).collect())
    assert kept == [(-1, "a b c"), (1, "w0 w1"), (5, ""), (5, ""), (6, "")]
    assert minhash.representatives(docs).columns == ["doc_id", "text"]


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.representatives(empty).count() == 0


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(4)
    a, b = (draw.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 300))
    one, two = (minhash.registers(x, np.array([0]))[0] for x in (a, b))
    both = minhash.registers(np.concatenate((a, b)), np.array([0]))[0]
    assert (np.maximum(one, two) == both).all()
    agree, above = (one == both).sum(), (one > both).sum()
    counts = [np.array([x]) for x in (agree, above, len(one) - agree - above)]
    estimate = minhash.likely(*counts, np.array([900.0]), np.array([1200.0]), 0.7)
    assert abs(estimate[0] - 0.75) < 0.15
    assert minhash.likely(*counts, np.array([900.0]), np.array([1200.0]), 0.8)[0] == -1


def vector_rows():
    draw = np.random.default_rng(8)
    base = draw.normal(size=(60, 8))
    near = base[:5].repeat(12, 0) + draw.normal(scale=0.08, size=(60, 8))
    rows = [v.tolist() for v in np.concatenate((base, near))]
    rows += [rows[0], rows[0], [2 * x for x in rows[1]], [0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8]
    rows += [[1.0, 2.0], [2.0, 4.0], [1e30, 1e30], [1e-30, 1e-30]]
    return rows


@pytest.mark.parametrize("cell,block", [(8192, 8192), (10, 8192), (10, 3)])
def test_vectors_against_plain_python(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "OWN_BLOCK", block)
    monkeypatch.setattr(vectors, "MEMBER_BLOCK", 2 * block)
    values = vector_rows()
    good = [v if v and None not in v and np.isfinite(v).all() and np.any(v) else None for v in values]
    links = []
    for a, b in itertools.combinations(range(len(values)), 2):
        if good[a] and good[b] and len(good[a]) == len(good[b]):
            x, y = (np.array(good[i]) / np.abs(good[i]).max() for i in (a, b))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links.append((a, b))
    groups = least_reachable(range(len(values)), links)
    counts = {i: sum(i in link for link in links) for i in groups}
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(values)], "vec_id long, embedding array<double>, kept int, k1 int")
    found = vectors.near_duplicates(table)
    assert found.columns == ["vec_id", "embedding", "k1", "n_links", "component_id", "kept"]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()}
    assert got == {i: (counts[i], groups[i], groups[i] == i) for i in groups}


def test_vectors_without_ids_and_without_rows(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.01]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in vectors.near_duplicates(table).collect())
    assert got == [(-1, 0, -1, True), (-1, 2, 4, False), (-1, 2, 4, False), (4, 2, 4, True)]
    assert vectors.near_duplicates(table.limit(0)).count() == 0


def test_a_large_group_of_exact_and_near_copies(spark):
    """10,000 equal rows (some of one doc_id, some of none) and 5,000 that differ from them by a word each."""
    words = [f"w{i}" for i in range(300)]
    text = " ".join(words)
    near = [" ".join([*words[: i % 290], f"x{i}", *words[i % 290 + 1 :]]) for i in range(5000)]
    rows = [(i if i % 100 else (None if i % 200 else 5), text) for i in range(1, 10_001)] + [(20_000 + i, x) for i, x in enumerate(near)]
    rows += [(50_000 + i, " ".join(f"other{i}x{j}" for j in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    found = minhash.near_duplicates(docs).groupBy("component_id").count().collect()
    counts = {r["component_id"]: r["count"] for r in found}
    assert counts.pop(1) == 15_000 and len(counts) == 20 and set(counts.values()) == {1}
    kept = minhash.representatives(docs).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, *range(50_000, 50_020)]


def test_recall_just_above_the_threshold(spark):
    """Pairs whose similarity is 85 to 86 per cent: nearly all of them are linked, and none below."""
    rows, wanted, below = [], [], []
    for pair in range(1500):
        words = [f"p{pair}w{i}" for i in range(400)]
        other = list(words)
        # each change in the middle replaces five shingles: 6 changes leave 366 of 426, 7 leave 361 of 431
        for change in range(6 if pair % 3 else 7):
            other[20 + 50 * change] = "changed"
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
        (wanted if pair % 3 else below).append(pair)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {r["component_id"] // 2 for r in minhash.near_duplicates(docs).filter("NOT kept").collect()}
    assert not linked & set(below)
    assert len(linked) / len(wanted) >= 0.999
