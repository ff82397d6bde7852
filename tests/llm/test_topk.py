"""Exact top-k search against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitworks.llm import topk


def plain(rows, is_query, k):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = {}
    for i, q in good:
        if is_query(i):
            scores = [(-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q)]
            out[i] = [(rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k])]
    return {i: x for i, x in out.items() if x}


@pytest.mark.parametrize("shard,step", [(8192, 1024), (16, 5)])
def test_against_plain_python(spark, monkeypatch, shard, step):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "STEP", step)
    draw = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=20)]) for i in range(90)]
    rows += [(90 + i, rows[3][1]) for i in range(8)]  # ties
    rows += [(100, None), (110, []), (120, [None] * 20), (130, [float("inf")] * 20), (None, rows[0][1]), (140, [1.0, 2.0]), (141, [0.0, 3.0])]
    rows += [(150, [0.0] * 20), (160, [float(np.float32(3e7))] * 20), (161, [-1.0] * 20)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = {}
    for r in topk.top_k(table, F.col("vec_id") % 10 == 0, 5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in found.items()} == plain(rows, lambda i: i % 10 == 0, 5)


def test_bounds_are_never_below_the_product():
    draw = np.random.default_rng(7)
    a, b = topk.scaled(draw.normal(size=(50, 33))), topk.scaled(draw.normal(size=(40, 33)))
    for segments in topk.LEVELS:
        assert (topk.features(a, segments) @ topk.features(b, segments).T >= a @ b.T - 1e-3).all()


def test_no_rows_and_no_queries(spark):
    table = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(table, F.col("vec_id") == 0).count() == 0
    assert topk.top_k(table.limit(0), F.col("vec_id") == 0).count() == 0
