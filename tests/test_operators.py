"""Operators that SQL cannot express, against brute force, and their edge cases."""

from __future__ import annotations

import difflib
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidloom.functions import extract
from evidloom.operators import evidence, governance, learning, series
from evidloom.plans import learning as learning_plans, registry
from evidloom.sources import files

registry.load()


def test_line_diffs(spark):
    rows = spark.createDataFrame([("a\nb\nc", "a\nx\nc"), (None, "y"), ("same", "same")], "a string, b string")
    got = [r[0] for r in rows.select(extract.line_diff("a", "b")).collect()]
    assert got[0] == "\n".join(difflib.unified_diff(["a", "b", "c"], ["a", "x", "c"], n=2, lineterm="")) and "+y" in got[1] and got[2] == ""


def test_rolling_origin(spark):
    values = [5 + i % 7 + i // 6 for i in range(30)]
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t int, v long")
    got = {r.model: r for r in learning.rolling_origin(s, "k", "t", "v").collect()}
    y = np.array(values, float)
    want = {m: [] for m in got}
    for t in range(24, 30):
        x = np.array([[1, *y[i - 3 : i]] for i in range(3, t)])
        w = np.linalg.inv(x.T @ x + np.diag([0, 1, 1, 1])) @ x.T @ y[3:t]
        for m, g in {"ridge": w @ [1, *y[t - 3 : t]], "last": y[t - 1], "seasonal": y[t - 12], "drift": y[t - 1] + (y[t - 1] - y[0]) / (t - 1)}.items():
            want[m].append((y[t] - g) ** 2)
    assert {m: r.n for m, r in got.items()} == dict.fromkeys(want, 6)
    assert {m: r.rmse for m, r in got.items()} == pytest.approx({m: np.sqrt(np.mean(e)) for m, e in want.items()})


def test_series_that_are_refused(spark):
    s = spark.createDataFrame([("gap", "2020-01-01", 1), ("gap", "2020-03-01", 2), ("flat", "2020-01-01", 3), ("flat", "2020-02-01", 3), ("good", "2020-01-01", 1), ("good", "2020-02-01", 2)], "k string, d string, v int").withColumn("d", F.to_date("d"))
    assert {r.k: r.reason for r in learning.regular(s, "k", "d", "v").collect()} == {"gap": "mixed_or_irregular_periods", "flat": "constant_or_zero_series", "good": None}
    assert [(r.lags, r.target) for r in learning.lag_rows(s, "k", "d", "v", 1).where("k = 'good'").collect()] == [([1], 2)]


def test_scaling_knows_training_rows_only(spark):
    rows = spark.createDataFrame([(0.0, 1.0, True), (10.0, 1.0, True), (1000.0, 5.0, False)], "x double, c double, train boolean")
    assert [r.x for r in learning.min_max(rows, ["x"], F.col("train")).orderBy("x").collect()] == [0.0, 1.0, 100.0]
    assert {r.c for r in learning.standardised(rows.where("train"), ["c"]).collect()} == {0.0}


def test_inflation(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=200), r.normal(size=200)
    rows = spark.createDataFrame([(float(x), float(y), float(2 * x), 1.0) for x, y in zip(a, b, strict=True)], "a double, b double, twice double, one double")
    got = {x.feature: x for x in learning.inflation(rows, ["a", "b", "twice", "one"]).collect()}
    assert got["a"].vif == float("inf") and not got["a"].kept and got["b"].vif < 2 and got["b"].kept and not got["one"].kept


def test_models_tell_quality(spark):
    sf = "/root/testdata/sf0.01"
    try:
        trees = registry.QUERIES["alignment_trees"](spark, sf).where("NOT train").agg(F.avg((F.col("aligned") == (F.col("label") == 1)).cast("int"))).first()[0]
    except Exception as e:
        pytest.skip(str(e)[:80])
    assert trees > 0.8


def test_logistic(spark, sf_dir):
    out = learning_plans.alignment_logistic(spark, sf_dir)
    assert out.count() > 0 and out.where("score < 0 OR score > 1").count() == 0


def test_safe_boundary_with_groups_that_cross(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c"), (6, "d"), (7, "d"), (8, "e")], "t int, g string")
    assert [tuple(r) for r in series.safe_boundary(rows, "g", "t", 0.3).collect()] == [(4, 8, 0.5)]
    assert series.safe_boundary(rows.where("g IN ('a', 'b')"), "g", "t", 0.5).count() == 0


def test_stratified(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, s string")
    assert {r.s: r["count"] for r in series.stratified(rows, "s", "id", 5).groupBy("s").count().collect()} == {"a": 3, "b": 2}


def test_merged_maps(spark):
    m = spark.range(1).select(governance.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))).first()[0]
    assert m == {"a": "1", "b": "3"}


def test_rules_and_scopes(spark):
    rows = spark.createDataFrame([(1, "x y", "x"), (2, "q", None)], "id int, whole string, first string")
    skills = spark.createDataFrame([("s", "x y", "x"), ("t", "zz", "x")], "skill string, whole string, first string")
    assert sorted(tuple(r) for r in evidence.by_rules(rows, skills, "id", "skill", [("whole", 0.9), ("first", 0.5)]).collect()) == [(1, "s", 1, 0.9), (1, "t", 2, 0.5)]
    some = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "c", False)], "k int, v string, own boolean")
    assert sorted(r.v for r in evidence.scoped_or_all(some, "k", "own").collect()) == ["a", "c"]
    assert (evidence.clamped(0, 5), evidence.clamped(9, 5)) == (1, 5)


def test_rules_are_tried_once_for_equal_values(spark):
    rows = spark.range(4000).selectExpr("id", "concat('w', id % 3) AS whole", "if(id % 2 = 0, 'x', null) AS first").union(spark.createDataFrame([(0, "w1", None)], "id long, whole string, first string"))
    skills = spark.createDataFrame([("s", "w0", "x"), ("t", "w1", "y")], "skill string, whole string, first string")
    out = evidence.by_rules(rows, skills, "id", "skill", [("whole", 0.9), ("first", 0.5)])
    got = {(r.id, r.skill): (r.rule, r.confidence) for r in out.collect()}
    want = {(i, "s"): (1, 0.9) if i % 3 == 0 else (2, 0.5) for i in range(4000) if i % 3 == 0 or i % 2 == 0} | {(i, "t"): (1, 0.9) for i in range(4000) if i % 3 == 1 or i == 0}
    assert got == want and out.count() == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("rule" in line and "id#" in line.split("[")[1] for line in plan.splitlines() if "Aggregate [" in line)


def test_codes_and_votes(spark):
    codes = spark.createDataFrame([("2",), ("25",), ("2512",), ("31",)], "code string")
    assert {r.code: r.parent for r in governance.longest_prefix(codes, "code").collect()} == {"2": None, "25": "2", "2512": "25", "31": None}
    votes = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2), (1, "b", "y", 3), (1, "c", "y", 4), (2, "a", "x", 1), (3, "a", "x", 1), (3, "b", "x", 2), (4, "a", "x", 1), (4, "b", "y", 2)], "task int, reviewer string, label string, at int")
    assert {r.task: (r.state, r.final) for r in governance.adjudicated(votes).collect()} == {1: ("adjudicated", "y"), 2: ("first_done", None), 3: ("complete", "x"), 4: ("needs_adjudication", None)}


def test_csv_lanes_stream_and_bundle(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("id,n\n1,10\n2,bad\n3,30\n4,40\n")
    good, bad = files.read_csv_rows(spark, str(tmp_path / "in/a.csv"), "id int, n int", start_row=2, max_rows=2)
    assert [(r._row, r.id) for r in good.collect()] == [(3, 3)] and [r.line for r in bad.collect()] == ["2,bad"]
    (tmp_path / "in/b.csv").write_text("id,n\n4,40\n5,50\n")
    batches = files.import_csv(spark, str(tmp_path / "in"), "id int, n int", str(tmp_path / "out"), str(tmp_path / "state"), "id")
    assert sum(batches) == 6 and sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 5]
    digest = hashlib.sha256((tmp_path / "in/b.csv").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("b.csv", 1, digest, 2), ("a.csv", 2, "x", 4), ("z.csv", 3, "y", 1)], "file string, phase int, sha256 string, rows int")
    assert {r.file: r.state for r in files.checked_bundle(spark, str(tmp_path / "in"), manifest).collect()} == {"b.csv": "ok", "a.csv": "changed", "z.csv": "missing"}


def test_names(spark):
    assert extract.unique_names(["Name", "name ", "", "Size", "NAME"]) == ["name", "name_2", "column", "size", "name_3"]
    row = spark.createDataFrame([(" ", "b", "a_b%c")], "x string, y string, z string").select(extract.first_filled("x", "y").alias("f"), evidence.escaped_like(F.col("z"), "A_B%").alias("l"), evidence.escaped_like(F.col("z"), "a%b").alias("m")).first()
    assert (row.f, row.l, row.m) == ("b", True, False)


def test_only_common_terms_are_counted_for_each_key(spark):
    rng = np.random.default_rng(5)
    everywhere = [f"all{i:02d}" for i in range(12)]  # more than twice the vocabulary, in every text, so that more terms must be tried
    texts = [(i // 2 if i < 80 else None, " ".join([*everywhere * 3, *(f"w{int(x)}" for x in rng.zipf(1.5, 20) if x < 40)])) for i in range(82)]
    docs = spark.createDataFrame(texts, "k int, t string").repartition(3)
    every = learning.term_counts(docs, "k", "t")
    n_docs = spark.createDataFrame([(41,)], "n_docs long")  # two rows a key, and one key is null
    for size in (5, 256):
        counts, found = learning.common_counts(docs, "k", "t", n_docs, size)
        want = [tuple(r) for r in learning.vocabulary(every, n_docs, size).collect()]
        assert sorted(tuple(r) for r in found.collect()) == sorted(want) and 0 < len(want) <= size
        rows = lambda c: sorted(map(str, c.join(found, "term", "left_semi").select("k", "term", "n").collect()))
        assert rows(counts) == rows(every)
    assert learning.common_counts(docs, "k", "t", n_docs, 20)[0].select("term").distinct().count() <= 40 < every.select("term").distinct().count()


def test_the_most_wanted_terms_that_a_key_lacks_are_added(spark):
    weights = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.8), (2, "z", 1.0), (None, "d", 1.0)], "k int, term string, weight double")
    demand = spark.createDataFrame([("a", 5.0), ("c", 2.0), ("b", 2.0), ("d", 1.0)], "term string, weight double")
    got = {(r.k, r.term, r.weight) for r in learning.with_missing(weights, "k", demand, 2).collect()}
    assert got == {(1, "a", 0.6), (1, "b", 0.8), (1, "c", 2.0), (1, "d", 1.0), (2, "z", 1.0), (2, "a", 5.0), (2, "b", 2.0), (None, "d", 1.0), (None, "a", 5.0), (None, "b", 2.0)}
    assert {tuple(r) for r in learning.with_missing(weights, "k", demand.where("false"), 2).collect()} == {tuple(r) for r in weights.collect()}
