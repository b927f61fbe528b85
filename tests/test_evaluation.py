"""Evaluation against direct computation."""

from __future__ import annotations

import random
import threading
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from evidloom.operators import evaluation, quality
from evidloom.plans import registry

registry.load()


def curve_by_hand(y, p):
    out = {}
    for t in sorted(set(p)):
        hit = [a for a, s in zip(y, p) if s >= t]
        precision, recall = sum(hit) / len(hit), sum(hit) / sum(y)
        out[t] = (precision, recall, 2 * precision * recall / max(precision + recall, 1e-12))
    return out


@pytest.fixture(scope="module")
def scores():
    rng = random.Random(8)
    p = [min(1.0, max(0.0, round(rng.gauss(0.5, 0.3), 2))) for _ in range(400)]
    return [int(rng.random() < 0.2 + 0.6 * s) for s in p], p


def test_curves(spark, scores):
    y, p = scores
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double").repartition(5)
    got = {r.threshold: (r.precision, r.recall, r.f1) for r in evaluation.precision_recall(df, "y", "p").collect()}
    want = curve_by_hand(y, p)
    assert set(got) == set(want) and all(got[t] == pytest.approx(want[t]) for t in want)
    steps = sorted(want, reverse=True)
    area, before = 0.0, 0.0
    for t in steps:
        area, before = area + (want[t][1] - before) * want[t][0], want[t][1]
    assert evaluation.average_precision(df, "y", "p").first()[0] == pytest.approx(area)
    best = max(sorted(want), key=lambda t: round(want[t][2], 12))
    assert evaluation.best_threshold(evaluation.precision_recall(df, "y", "p")).first()["threshold"] == best


def test_report_and_calibration(spark, scores):
    y, p = map(np.array, scores)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double")
    r = evaluation.report(df, "y", "p", spark.createDataFrame([(0.5,)], "threshold double")).first()
    hit = p >= 0.5
    tp, fp, fn, tn = (int((a & b).sum()) for a, b in ((hit, y == 1), (hit, y == 0), (~hit, y == 1), (~hit, y == 0)))
    assert (r.tp, r.fp, r.fn, r.tn, r.n) == (tp, fp, fn, tn, 400)
    assert r.brier == pytest.approx(((p - y) ** 2).mean()) and r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn)) and r.balanced_accuracy == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
    order = np.argsort(p)
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in p[y == 0]] for a in p[y == 1]])
    assert r.roc_auc == pytest.approx(auc, abs=1e-4) and len(order) == 400
    bins = np.minimum(np.digitize(p, np.linspace(0, 1, 11)[1:-1]), 9)
    gaps = {b: (abs(p[bins == b].mean() - y[bins == b].mean()), (bins == b).sum()) for b in set(bins.tolist())}
    c = evaluation.calibration_summary(df, "y", "p").first()
    assert c.ece == pytest.approx(sum(g * n for g, n in gaps.values()) / 400) and c.mce == pytest.approx(max(g for g, _ in gaps.values()))
    assert c.status == ("passed" if c.ece <= 0.1 else "review_required")
    assert evaluation.calibration_summary(df.limit(5), "y", "p").first().status == "insufficient_data"
    assert evaluation.calibration_summary(df.where("false"), "y", "p").first().status == "insufficient_data"


def test_folds_look_back_only(spark):
    rows = spark.createDataFrame([(g, t) for g in range(50) for t in (g * 10 + 3, g * 10)] + [(None, 1)], "g long, t long")
    got = {r.g: r for r in evaluation.group_folds(rows, "g", "t").collect()}
    assert len(got) == 50 and [got[g].number for g in range(50)] == list(range(50))
    assert {g for g in got if got[g].split == "test"} == set(range(40, 50))
    for fold, end in enumerate((20, 26, 32), 1):
        assert {g for g in got if got[g].validates == fold} == set(range(end, end + 4))
        assert {g for g in got if got[g].trains is not None and got[g].trains <= fold} == set(range(end))


def test_percentiles_without_one_buffer(spark):
    rng = random.Random(1)
    v = [rng.choice([1.0, 2.0, rng.random() * 1e9, None]) for _ in range(500)] + [1e300]
    df = spark.createDataFrame([(x,) for x in v], "v double").repartition(4)
    known = sorted(x for x in v if x is not None)
    for share in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert quality.percentile(df, "v", share).first()[0] == pytest.approx(np.quantile(known, share))
        assert quality.nearest_rank(df, None, "v", max(share, 0.01)).first()[0] == known[int(np.ceil(max(share, 0.01) * len(known))) - 1]


def test_out_of_fold(spark, sf_dir):
    rows = registry.QUERIES["out_of_fold_scores"](spark, sf_dir).collect()
    assert {r.fold for r in rows} <= {1, 2, 3} and len(rows) >= 5 and all(0 <= r.score <= 1 for r in rows)
    report = registry.QUERIES["locked_report"](spark, sf_dir).first()
    assert report.n > 0 and report.tp + report.fp + report.fn + report.tn == report.n


def test_folds_are_learnt_side_by_side(spark):
    rows = spark.createDataFrame([(i, 1 + i // 4 if i < 12 else None, 1 + i // 4) for i in range(16)], "id int, trains int, validates int")
    all_there = threading.Barrier(len(evaluation.FOLD_ENDS), timeout=60)

    def fit(train):
        all_there.wait()  # broken, unless all folds are at it
        return train.count()

    got = evaluation.out_of_fold(rows, fit, lambda m, held: held.withColumn("score", F.lit(m))).collect()
    assert {(r.id, r.fold, r.score) for r in got} == {(i, 1 + i // 4, 4 * (1 + i // 4)) for i in range(12)}


def test_models_beat_chance_on_held_out_rows(spark):
    path = "/root/testdata/sf0.01"
    held = registry.QUERIES["alignment_logistic"](spark, path).where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).withColumn("label", F.col("label").cast("int"))
    assert quality.roc_auc(held, "label", "score").first().auc > 0.65


def test_a_model_is_used_after_a_query_was_observed(spark):
    rows = spark.createDataFrame([(i, "good fine text" if i % 2 else "poor words", float(i % 2)) for i in range(20)], "id int, t string, y double")
    spark.range(5).observe(Observation(), F.count("*").alias("n")).count()
    out = evaluation.scored_by(evaluation.text_logistic(rows, "t", "y"), rows, "t").collect()
    assert all((r.score > 0.5) == (r.y == 1) for r in out) and len(out) == 20


def test_common_terms_are_those_of_all_words_and_pairs(spark):
    rng = random.Random(3)
    texts = [[rng.choice("aabbbcdefgh") for _ in range(rng.choice([0, 1, 2, 9, 30]))] for _ in range(60)] + [["x", "y"] * 20]
    n = Counter(w for t in texts for w in t) + Counter(" ".join(p) for t in texts for p in pairwise(t))
    order = sorted(n.items(), key=lambda i: (-i[1], " " in i[0], i[0]))
    rows = spark.createDataFrame([(t,) for t in texts], "w array<string>").repartition(3)
    for size in (1, 4, 12, 25, 1000):
        assert [tuple(r) for r in evaluation.common_terms(rows, "w", size).collect()] == order[:size]


def test_rows_are_scored_as_by_the_model_of_those_that_train(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["good", "fine", "day"] if i % 2 else ["poor", "bad", "day"]) for _ in range(6)) for i in range(40)] + ["", None, "new words"]
    rows = spark.createDataFrame([(i, t, float(i % 2)) for i, t in enumerate(texts)], "id int, t string, y double")
    trains = F.col("id") % 3 != 0
    want = {r.id: r.score for r in evaluation.scored_by(evaluation.text_logistic(rows.where(trains), "t", "y", 5), rows, "t").collect()}
    got = evaluation.text_logistic_scores(rows, trains, "t", "y", 5)
    assert got.columns == ["id", "y", "score"] and {r.id: r.score for r in got.collect()} == pytest.approx(want, abs=1e-6) and len(want) == 43
