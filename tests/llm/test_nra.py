import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import nra


def brute(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            scores = sorted(((-int(np.dot(v, w)), i) for i, w in good if i != q))[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("query_bytes", [1 << 24, 700])
def test_equals_brute_force(spark, monkeypatch, query_bytes):
    monkeypatch.setattr(nra, "QUERY_BYTES", query_bytes)  # 700: one pass for some seven queries
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(300)]
    rows += [(i, [0.5] * 12) for i in range(300, 360)]  # ties
    rows += [(1000, None), (1005, []), (1010, [float("nan")] * 12), (1015, [float("inf")] + [0.0] * 11), (1020, [None] + [0.1] * 11), (None, [0.1] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(map(tuple, nra.topk(df, lambda i: i % 5 == 0).collect()))
    assert got == brute(rows, 5, 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, nra.topk(df, lambda i: i % 5 == 0).collect())) == [(0, 1, 5, 131072), (5, 1, 0, 131072)]
    assert nra.topk(df.limit(0), lambda i: i % 5 == 0).count() == 0
    assert nra.topk(df.withColumn("query_id", F.lit(1)), lambda i: i == 1).count() == 0


def test_mixed_lengths_keep_all_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [2.0]), (6, [3.0, 1.0])], "vec_id long, embedding array<double>")
    want = [(0, 1, 6, 5 << 16), (0, 2, 5, 2 << 16), (5, 1, 6, 6 << 16), (5, 2, 0, 2 << 16)]
    assert sorted(map(tuple, nra.topk(df, lambda i: i % 5 == 0).collect())) == want


@pytest.mark.parametrize("scale", [1, 1 << 14, 1 << 20])
def test_blocks_read_in_steps_and_stop_early(scale):
    """Clustered vectors, long ones first: bounds of 32 and 64 bits, and beyond; what is read is counted."""
    rng = np.random.default_rng(2)
    ids, vectors = np.arange(1200), (rng.normal(0, 20, (1200, 8)) * scale).astype(np.int64)
    vectors[::3] *= 4
    queries = np.arange(0, 1200, 40)
    best = nra.Best(queries, vectors[queries], 5)
    for a in range(0, 1200, 300):
        best.add(ids[a : a + 300], vectors[a : a + 300])
    for i, q in enumerate(queries.tolist()):
        scores = [(-sum(int(x) * int(y) for x, y in zip(vectors[q], vectors[c])), c) for c in range(1200) if c != q]
        assert list(zip((-best.scores[i]).tolist(), best.ids[i].tolist())) == sorted(scores)[:5]
    assert best.held == 1200 and (best.read > 0).all() and best.read.mean() < 0.8 * best.held


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(3)
    vectors, queries = rng.integers(-9, 9, (60, 5)), rng.integers(-9, 9, (7, 5))
    lists, exact, at = nra.Lists(np.arange(60), vectors.astype(float)), queries @ vectors.T, np.arange(60)
    widths = []
    for depth in range(1, 61):
        upper, lower = lists.bounds(depth, queries.astype(float), at, True)
        assert (lower <= exact).all() and (exact <= upper).all()
        widths.append((upper - lower).sum())
    assert widths[-1] == 0 and all(x >= y for x, y in zip(widths, widths[1:]))


def test_report_counts_what_is_read(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = nra.topk(vectors, lambda i: i % 50 == 0, report=True).collect()
    assert rows and all(0 < r["read"] < r["held"] for r in rows)
