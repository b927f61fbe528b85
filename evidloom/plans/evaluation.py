"""Folds in time, curves, calibration and out-of-fold evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.operators import evaluation
from evidloom.plans.quality import _PRED, _predicted
from evidloom.plans.registry import query, table

_CURVE = f"{_PRED}, g AS (SELECT score, sum(quality)::DOUBLE AS p, count(*)::DOUBLE AS n FROM p GROUP BY 1), r AS (SELECT score, p, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS all_p FROM g WINDOW w AS (ORDER BY score DESC)), c AS (SELECT score AS threshold, p, tp, k - tp AS fp, tp / k AS precision, tp / all_p AS recall, 2 * (tp / k) * (tp / all_p) / greatest(tp / k + tp / all_p, 1e-12) AS f1, all_p FROM r)"
_EDGES = " + ".join(f"(s >= {float(e)!r}::DOUBLE)::INT" for e in evaluation.np.linspace(0.0, 1.0, 11)[1:-1])
_BINS = f"{_PRED}, b AS (SELECT 1 + {_EDGES} AS bin, s, quality::DOUBLE AS y FROM (SELECT greatest(0, least(1, score)) AS s, quality FROM p)), g AS (SELECT bin, count(*) AS n, avg(s) AS mean_score, avg(y) AS rate, abs(avg(s) - avg(y)) AS gap FROM b GROUP BY 1)"


@query("group_folds", """WITH g AS (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1), o AS (SELECT o_custkey, row_number() OVER (ORDER BY f, o_custkey) - 1 AS number, floor(count(*) OVER () * 0.8::DOUBLE)::BIGINT AS m FROM g),
e AS (SELECT *, greatest(2, floor(m * 0.5::DOUBLE)) AS e1, greatest(2, floor(m * 0.65::DOUBLE)) AS e2, greatest(2, floor(m * 0.8::DOUBLE)) AS e3, greatest(1, floor(m / 10.0::DOUBLE)) AS z FROM o)
SELECT o_custkey, number, CASE WHEN number < m THEN 'development' ELSE 'test' END AS split, CASE WHEN number >= m THEN NULL WHEN number >= e1 AND number < e1 + z THEN 1 WHEN number >= e2 AND number < e2 + z THEN 2 WHEN number >= e3 AND number < e3 + z THEN 3 END AS validates,
  CASE WHEN number >= m THEN NULL WHEN number < e1 THEN 1 WHEN number < e2 THEN 2 WHEN number < e3 THEN 3 END AS trains FROM e""")
def group_folds(spark, sf):
    """Customers by their first order: development folds that only look back, and a test that none of them sees."""
    return evaluation.group_folds(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@query("precision_recall", f"WITH {_CURVE} SELECT threshold, tp, fp, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM c")
def precision_recall(spark, sf):
    c = evaluation.precision_recall(_predicted(spark, sf), "quality")
    return c.select("threshold", "tp", "fp", *[F.round(x, 8).alias(x) for x in ("precision", "recall", "f1")])


@query("average_precision", f"WITH {_CURVE} SELECT round(sum(precision * p / all_p), 8) AS pr_auc FROM c")
def average_precision(spark, sf):
    return evaluation.average_precision(_predicted(spark, sf), "quality").select(F.round("pr_auc", 8).alias("pr_auc"))


@query("best_threshold", f"WITH {_CURVE} SELECT threshold, round(f1, 8) AS f1 FROM c ORDER BY round(c.f1, 12) DESC, threshold LIMIT 1")
def best_threshold(spark, sf):
    return evaluation.best_threshold(evaluation.precision_recall(_predicted(spark, sf), "quality")).select("threshold", F.round("f1", 8).alias("f1"))


@query("reliability", f"WITH {_BINS} SELECT bin, n, round(mean_score, 8) AS mean_score, round(rate, 8) AS rate, round(gap, 8) AS gap FROM g")
def reliability(spark, sf):
    return evaluation.reliability(_predicted(spark, sf), "quality", "score").select("bin", "n", *[F.round(x, 8).alias(x) for x in ("mean_score", "rate", "gap")])


@query("calibration_summary", f"WITH {_BINS}, t AS (SELECT sum(gap * n) / sum(n) AS ece, max(gap) AS mce, sum(n)::BIGINT AS n FROM g) SELECT n, round(ece, 8) AS ece, round(mce, 8) AS mce, round((SELECT avg((s - y) * (s - y)) FROM b), 8) AS brier, CASE WHEN n < 30 OR (SELECT count(DISTINCT y) FROM b) <> 2 THEN 'insufficient_data' WHEN ece <= 0.1 THEN 'passed' ELSE 'review_required' END AS status FROM t")
def calibration_summary(spark, sf):
    return evaluation.calibration_summary(_predicted(spark, sf), "quality", "score").select("n", *[F.round(x, 8).alias(x) for x in ("ece", "mce", "brier")], "status")


def _labelled(spark, sf):
    """Texts with their quality; documents of near numbers are a group, and numbers stand for time."""
    rows = table(spark, sf, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("label")).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.withColumn("group", F.expr("doc_id div 4"))


def _folded(spark, sf):
    rows = _labelled(spark, sf)
    folds = evaluation.group_folds(rows, "group", "doc_id")
    return rows.join(folds, "group")


def _fit(train):
    classes = train.agg(F.count_distinct("label")).first()[0]
    return evaluation.text_logistic(train, "text", "label") if classes == 2 else None


@query("out_of_fold_scores")
def out_of_fold_scores(spark, sf):
    """Validation documents of three expanding folds, each scored by what its fold learnt before; accuracy is tested."""
    found = evaluation.out_of_fold(_folded(spark, sf), _fit, lambda m, held: evaluation.scored_by(m, held, "text"))
    return found.select("doc_id", "group", "fold", "label", "score")


@query("locked_report")
def locked_report(spark, sf):
    """The untouched last groups, scored by a model of all development groups, at the threshold that was best out of fold."""
    rows = evaluation.stored(_folded(spark, sf), "folded")[0]
    pooled, model = evaluation.at_once(lambda step: step(), [lambda: evaluation.out_of_fold(rows, _fit, lambda m, held: evaluation.scored_by(m, held, "text")), lambda: _fit(rows.where("split = 'development'"))])
    curve = evaluation.precision_recall(pooled, "label")
    at = evaluation.best_threshold(curve).select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"))
    if model is None:
        raise ValueError("not evaluable: the development groups hold one class only")
    scored = evaluation.stored(evaluation.scored_by(model, rows.where("split = 'test'"), "text").select("doc_id", "label", "score"), "locked")[0]
    out = evaluation.report(scored, "label", "score", at).join(F.broadcast(evaluation.calibration_summary(scored, "label", "score").select("ece", "mce", "status")))
    return out.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes])
