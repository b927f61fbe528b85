"""Filling of missing values against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from evidloom.operators import imputation


def by_hand(rows, k):
    """Each value in turn, from all rows that have it."""
    n = len(rows[0])
    means = [np.mean([r[c] for r in rows if r[c] is not None]) if any(r[c] is not None for r in rows) else None for c in range(n)]
    out = []
    for r in rows:
        filled = list(r)
        for c in range(n):
            if r[c] is None:
                near = []
                for at, s in enumerate(rows):
                    both = [i for i in range(n) if r[i] is not None and s[i] is not None]
                    if s[c] is not None and both:
                        near.append((math.sqrt(n / len(both) * sum((r[i] - s[i]) ** 2 for i in both)), at, s[c]))
                near = sorted(near)[:k]
                if any(d == 0 for d, _, _ in near):
                    near = [(1, 0, v) for d, _, v in near if d == 0]
                filled[c] = sum(v / d for d, _, v in near) / sum(1 / d for d, _, _ in near) if near else means[c]
        out.append(filled)
    return out


def test_nearest_rows(monkeypatch):
    monkeypatch.setattr(imputation, "BLOCK", 7)
    rng = random.Random(2)
    rows = [[None if rng.random() < 0.3 else round(rng.gauss(0, 1), 2) for _ in range(4)] for _ in range(60)] + [[None] * 4, [1.0, 2.0, None, 3.0], [1.0, 2.0, 5.0, 3.0]]
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    got = imputation.nearest_filled(x, x, np.nanmean(x, 0), 5)
    assert np.allclose(got, np.array(by_hand(rows, 5), float)) and got[-2, 2] == 5.0


def test_strategies(spark):
    rows = [(1, 1.0, 10.0, None), (2, None, 20.0, None), (3, 3.0, None, None), (4, 5.0, 40.0, 1.0), (None, 5.0, 40.0, None)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double").selectExpr("*", "'x' AS _mean_0")
    assert imputation.dense_columns(df, ["a", "b", "c"], 0.2) == ["a", "b"]
    by = lambda s: {r.k: tuple(r)[1:] for r in imputation.handled(df, "k", ["a", "b", "c"], s, 0.2).collect()}
    assert by("mean") == {1: (1.0, 10.0), 2: (3.5, 20.0), 3: (3.0, 27.5), 4: (5.0, 40.0), None: (5.0, 40.0)}
    assert by("drop") == {1: (1.0, 10.0), 4: (5.0, 40.0), None: (5.0, 40.0)}
    want = by_hand([[a, b] for _, a, b, _ in rows], 5)
    assert by("knn") == {r[0]: pytest.approx(tuple(w)) for r, w in zip(rows, want)}
    for s in ("mean", "drop", "knn"):
        assert imputation.handled(df.where("false"), "k", ["a", "b"], s).count() == 0
        assert imputation.handled(df.where("k = 3"), "k", ["b", "c"], s, 1.0).count() == (0 if s == "drop" else 1)


def test_reference_is_bounded(spark):
    df = spark.range(300).selectExpr("id AS k", "CAST(id AS double) AS a", "CASE WHEN id % 3 > 0 THEN id * 2.0 END AS b")
    got = imputation.knn_filled(df, "k", ["a", "b"], reference=60).collect()
    assert len(got) == 300 and np.mean([abs(r.b - 2 * r.k) for r in got]) < 15  # neighbours are about ten apart
