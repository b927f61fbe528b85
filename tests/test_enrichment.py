"""Hashed vectors, enrichment and retrieval on small tables."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from evidloom.functions.text import tokens
from evidloom.operators import enrichment


def vector_by_hand(words, size):
    v = [0.0] * size
    for w in words:
        h = hashlib.sha256(w.encode()).digest()
        v[int.from_bytes(h[:4], "big") % size] += -1 if h[4] % 2 else 1
    n = math.sqrt(sum(x * x for x in v))
    return [round(x / n, 8) for x in v] if n else None


def vectors(spark, rows):
    return enrichment.hashed_vectors(spark.createDataFrame(rows, "id string, text string"), "id", tokens(F.col("text")), 32)


def test_hashed_vectors(spark):
    rows = [("a", "welding and welding of steel"), ("b", ""), ("c", None), ("d", "data"), ("e", "data " * 500)]
    got = {r.id: r.v for r in vectors(spark, rows).collect()}
    assert got == {k: pytest.approx(v) for k, t in rows if (v := vector_by_hand((t or "").split(), 32))}


def test_enriched(spark):
    skills = vectors(spark, [("s1", "steel welding"), ("s2", "data analysis"), ("s3", "bread baking")])
    jobs = vectors(spark, [("o1", "welding steel"), ("o2", "baking")])
    links = spark.createDataFrame([("o1", "s3"), ("o1", "s1"), ("o2", "s2")], "occupation string, skill string")
    declared = spark.createDataFrame([("p1", "s1"), ("p1", "s1")], "id string, skill string")
    postings = vectors(spark, [("p1", "steel welding"), ("p2", "welding steel"), ("p3", "zebra quokka xylophone")])
    got = {r.id: (r.skills[:1], r.occupations[:1], r.linked) for r in enrichment.enriched(postings, skills, jobs, links, declared, least=0.95).collect()}
    assert got == {"p1": ([], ["o1"], ["s3"]), "p2": (["s1"], ["o1"], ["s1", "s3"]), "p3": ([], [], [])}


def test_retrieved(spark):
    sources = {"doc": vectors(spark, [("1", "steel welding"), ("2", "bread")]), "page": vectors(spark, [("1", "steel welding"), ("a:b", "welding")])}
    got = enrichment.retrieved(vectors(spark, [("q", "steel welding")]), sources, k=3).orderBy("rank").collect()
    assert [(r.rank, r.kind, r.id) for r in got] == [(1, "doc", "1"), (2, "page", "1"), (3, "page", "a:b")] and got[0].score == 1.0


def test_queries_are_hashed_once(spark):
    texts = vectors(spark, [("p1", "steel welding"), ("p2", "bread")])
    none = spark.createDataFrame([], "id string, skill string"), spark.createDataFrame([], "occupation string, skill string")
    skills = spark.createDataFrame([("s", [1.0] * 32)], "id string, v array<double>")
    enriched = enrichment.enriched(texts, skills, skills, none[1], none[0])
    found = enrichment.retrieved(texts, {"doc": skills})
    assert "sha2" in texts._jdf.queryExecution().toString()
    assert not any("sha2" in x._jdf.queryExecution().toString() for x in (enriched, found))
