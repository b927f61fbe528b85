"""Exact top-k search against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from evidloom.llm import impact_index as ii

WRAP = 1 << 64


def integers(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v]


def by_hand(rows, k=5, every=50):
    """Rows (query_id, rank, vec_id, score) of all pairs of rows."""
    own, out = [(i, e) for i, v in rows if (e := integers(v)) is not None], []
    for a, (i, q) in enumerate(own):
        if i is None or i % every:
            continue
        scores = []
        for b, (j, c) in enumerate(own):
            if a != b and len(q) == len(c):
                s = sum(x * y for x, y in zip(q, c, strict=True)) % WRAP
                scores.append((-(s - WRAP if s >= WRAP // 2 else s), j is None, j or 0))
        out += [(i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS row", "2 AS d", "'x' AS rank")
    return sorted((tuple(r) for r in ii.top_k(*ii.impact_index(df.repartition(3), **how), "id % 50 = 0").collect()), key=str)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * (1 + i % 3)).round(3).tolist()) for i in range(150)]
    rows += [(50, rows[50][1]), (50, rows[50][1]), (None, rows[0][1]), (None, rows[1][1])]  # repeated rows, no ids
    rows += [(200, None), (250, []), (251, []), (300, [1.0, None]), (350, [float("nan")] * 8), (400, [float("inf")] * 8), (450, [1.0] * 7), (451, [-2.0] * 7)]
    rows += [(i, [0.5] * 8) for i in range(500, 560)]  # ties
    rows += [(600, [1e300, -1e300, 1.0]), (601, [1e17, 3.0, -1e16]), (602, [-1e300, 5e15, 2.0]), (603, [1.0, 1.0, 1.0])]  # beyond any bound
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, rows, block=2048) == by_hand(rows)  # several blocks of 256 vectors
    assert found(spark, []) == []


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.25]), (50, [0.0, 0.0])]
    assert found(spark, rows) == by_hand(rows) == [(0, 1, 1, 65536), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(30, 400), st.integers(1, 20), st.integers(1, 7), st.sampled_from(["normal", "heavy", "copies", "zeros", "wide"]))
def test_block(seed, n, d, k, kind):
    rng = np.random.default_rng(seed)
    x = {"normal": rng.normal(size=(n, d)) * 30, "heavy": rng.standard_cauchy(size=(n, d)) * 30, "copies": rng.normal(size=(4, d))[rng.integers(0, 4, n)] * 30, "zeros": rng.integers(-1, 2, (n, d)), "wide": rng.normal(size=(n, d)) * 1e6}[kind]
    v = np.floor(np.clip(x, -1e8, 1e8)).astype(np.int64)
    rows, ids = np.arange(n) * 7, rng.permutation(n)
    asked = rng.choice(n, 9)
    j, r, score = ii.block_top(k, rows, ids, np.ones(n, bool), v, ii.segments(v), rows[asked], v[asked])
    for a, own in enumerate(asked):
        s = v @ v[own]
        want = [b for b in np.lexsort((ids, -s)) if b != own][:k]
        assert r[j == a].tolist() == want and score[j == a].tolist() == s[want].tolist()


def test_segments_state_what_is_left():
    v = np.floor(np.random.default_rng(1).normal(size=(300, 16)) * 40).astype(np.int64)
    whole, last = v.astype(float), np.inf
    for impact, dims, counts, members, left in ii.segments(v):
        assert impact <= last
        last, start = impact, 0
        for dim, count in zip(dims.tolist(), counts.tolist()):
            whole[members[start : start + count], abs(dim) - 1] -= impact * np.sign(dim)
            start += count
        exact = np.sqrt((whole**2).sum(1))
        assert (left >= exact).all() and np.allclose(left, exact, rtol=1e-4, atol=1e-4)


def test_stops_before_all_is_scored():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(4000, 32)) * 40).astype(np.int64)
    seen = []
    ii.block_top(5, np.arange(4000), np.arange(4000), np.ones(4000, bool), v, ii.segments(v), np.arange(200), v[:200], seen)
    assert [m for _, m in seen] and sum(m for _, m in seen) < 0.02 * 4000 * 200 and all(level < len(ii.LEVELS) for level, _ in seen)


@pytest.mark.parametrize("number", [0, 1])
def test_leading(number):
    sums = np.random.default_rng(number).normal(size=(503, 3)).astype(np.float32)
    lead = ii._leading(sums, 5)
    assert lead.shape == (3, 6) and all(len(set(x)) == 6 for x in lead.tolist())
    assert (sums.argmax(0)[:, None] == lead).any(1).all() or sums.argmax(0).max() >= 503 // 24 * 24
