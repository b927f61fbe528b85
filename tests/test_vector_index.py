"""The vector index against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from evidloom.operators import vector_index as vi


def rows_of(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>")


def clustered(n, d, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d)) * 2
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d))


def by_hand(vectors, asked, k, least):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v in enumerate(vectors) if v is not None and len(v) == len(vectors[0]) and np.linalg.norm(v) > 0}
    out = {}
    for i in asked:
        if i in unit:
            ranked = sorted(((-round(float(unit[i] @ u), 12), j) for j, u in unit.items()))[: 2 * k]
            out[i] = sorted((-round(-s, 6), j) for s, j in ranked if -s >= least)[:k]
    return out


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vi, "SLICE", 40)
    monkeypatch.setattr(vi, "ASKED", 3)
    v = [*clustered(300, 8), None, [], [0.0] * 8, [1.0] * 7, *clustered(1, 8).repeat(90, 0)]  # rows without direction, and a hot cell
    rows = rows_of(spark, v)
    index = vi.vector_index(rows, "id", "v", cells=6)
    assert index.table.count() == 390 and index.slices.agg(F.max("n")).first()[0] >= 3
    asked = [i for i in range(len(v)) if i % 10 == 0]
    got = vi.search(index, rows.where("id % 10 = 0"), "id", "v", k=7, least=0.1, exact=True).collect()
    want = by_hand(v, asked, 7, 0.1)
    own = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        own.setdefault(r.query_id, []).append((-r.score, r.id))
    assert own == {i: x for i, x in want.items() if x}


def test_index_recall(spark):
    rows = rows_of(spark, clustered(3000, 16))
    index = vi.vector_index(rows, "id", "v", cells=24)
    asked = rows.where("id % 100 = 0")
    r = vi.recall(vi.search(index, asked, "id", "v"), vi.search(index, asked, "id", "v", exact=True))
    shared, wanted, n = r.agg(F.sum("shared"), F.sum("wanted"), F.count("*")).first()
    assert n == 30 and wanted == 300 and shared / wanted >= 0.9 and index.probes < len(index.centres) // 2


def test_odd_tables(spark):
    none = rows_of(spark, [])
    index = vi.vector_index(none, "id", "v")
    assert vi.search(index, none, "id", "v").count() == 0
    one = rows_of(spark, [[1.0, 2.0]])
    index = vi.vector_index(one, "id", "v")
    assert [tuple(r) for r in vi.search(index, one, "id", "v").collect()] == [(0, 1, 0, 1.0)]


def test_recall_of_query(spark, sf_dir):
    from evidloom.plans.search import vector_index_recall

    shared, wanted = vector_index_recall(spark, sf_dir).agg(F.sum("shared"), F.sum("wanted")).first()
    assert shared / wanted >= 0.9
