"""Honest evaluation: folds of groups in time, pooled out-of-fold scores, curves and calibration.

Scores are counted by value first and then summed in order, range by range, so a curve over any number
of scores takes no single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.util import inheritable_thread_target

from evidloom.functions.text import tokens
from evidloom.operators.quality import roc_auc, running
from evidloom.tables import new_folder, stored

#: Fixed: share of groups that are developed on, where each fold's training ends, and what follows for validation.
DEVELOPMENT = 0.8
FOLD_ENDS = (0.5, 0.65, 0.8)
VALIDATION_PARTS = 10
LEAST_CALIBRATION_ROWS, WORST_ECE = 30, 0.10


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``rows`` with their place, from 0, in the order given: ranges are numbered by themselves and then by the rows before them."""
    place = F.monotonically_increasing_id()
    dealt, _ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", place), "numbered")
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("_part", part).withColumn("_within", within)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_within")).drop("_id", "_part", "_within", "_start")


def group_folds(rows: DataFrame, group: str, time: str) -> DataFrame:
    """(group, number, split, validates, trains): groups in order of their first time; the last part is a test that no fold sees.

    ``validates`` is the fold, from 1, whose validation the group is in, ``trains`` the first fold that trains on it (and all later do).
    """
    firsts = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(time).alias("_first"))
    order = numbered(firsts, ["_first", group])
    total = order.agg(F.floor(F.count("*") * DEVELOPMENT).alias("_m"))
    m, at = F.col("_m"), F.col("number")
    ends = [F.greatest(F.lit(2), F.floor(m * share)) for share in FOLD_ENDS]
    size = F.greatest(F.lit(1), F.floor(m / VALIDATION_PARTS))
    dev = at < m
    validates = F.coalesce(*[F.when(dev & (at >= e) & (at < e + size), f) for f, e in enumerate(ends, 1)])
    trains = F.coalesce(*[F.when(dev & (at < e), f) for f, e in enumerate(ends, 1)])
    return order.join(F.broadcast(total)).select(group, "number", F.when(dev, "development").otherwise("test").alias("split"), validates.alias("validates"), trains.alias("trains"))


def common_terms(rows: DataFrame, words: str, size: int) -> DataFrame:
    """(term, n): the ``size`` most common words and pairs of neighbours ("a b") in arrays of words; of equal ones words come first, then by spelling.

    A pair is no more common than either of its words, and behind them where equal, so only pairs of two of the ``size`` most common words are counted.
    """
    single, _ = stored(rows.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(size), "words")
    first, second = F.broadcast(single.select(F.col("term").alias("_a"))), F.broadcast(single.select(F.col("term").alias("_b")))
    pairs = rows.select(F.inline(F.arrays_zip(F.col(words).alias("_a"), F.slice(words, 2, F.size(words)).alias("_b")))).toDF("_a", "_b")  # the last word has no neighbour
    counted = pairs.join(first, "_a").join(second, "_b").groupBy("_a", "_b").agg(F.count("*").alias("n"))
    both = single.select("term", "n", F.lit(1).alias("_k")).unionByName(counted.select(F.concat_ws(" ", "_a", "_b").alias("term"), "n", F.lit(2).alias("_k")))
    return both.orderBy(F.desc("n"), "_k", "term").limit(size).select("term", "n")


def term_counter(words: DataFrame, size: int = 1000) -> PipelineModel:
    """Counts of the ``size`` most common words and pairs of words of ``words`` (_w), as a vector _c."""
    vocabulary = [r.term for r in common_terms(words, "_w", size).collect()]  # of ``size`` at most, a part of the model
    count = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_t", outputCol="_c")
    return PipelineModel(stages=[NGram(n=2, inputCol="_w", outputCol="_g"), SQLTransformer(statement="SELECT *, concat(_w, _g) AS _t FROM __THIS__"), count])


def counts_logistic(found: DataFrame, label: str) -> PipelineModel:
    """Inverse frequencies, and logistic regression in which both classes weigh alike, learnt from written counts (_c)."""
    n, share = found.agg(F.count("*"), F.avg(label)).first()
    share = min(max(share or 0.0, 1e-9), 1 - 1e-9)
    weighted = Pipeline(stages=[IDF(inputCol="_c", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_v")]).fit(found)
    y = F.col(label).cast("double")
    rows, _ = stored(weighted.transform(found).select(y.alias("label"), "_v", F.when(y == 1, 0.5 / share).otherwise(0.5 / (1 - share)).alias("_weight")), "weights")
    model = LogisticRegression(featuresCol="_v", labelCol="label", weightCol="_weight", regParam=1.0 / max(n, 1), standardization=False, maxIter=200).fit(rows)
    return PipelineModel(stages=[*weighted.stages, without_summary(model)])


def text_logistic(train: DataFrame, text: str, label: str, size: int = 1000) -> PipelineModel:
    """TF-IDF of words and pairs of words, and logistic regression in which both classes weigh alike, learnt from ``train`` alone.

    Counts of terms are written once; what is learnt reads them back.
    """
    words = train.select(tokens(F.col(text)).alias("_w"), F.col(label).cast("double").alias("label"))
    counts = term_counter(words, size)
    found, _ = stored(counts.transform(words).select("label", "_c"), "terms")
    return PipelineModel(stages=[*counts.stages, *counts_logistic(found, "label").stages])


def text_logistic_scores(rows: DataFrame, trains: Column, text: str, label: str, size: int = 1000) -> DataFrame:
    """``rows`` without their text, with the score by the ``text_logistic`` of those that train. Terms of a text are counted once, to learn and to score."""
    words = rows.select(*[c for c in rows.columns if c != text], trains.alias("_trains"), tokens(F.col(text)).alias("_w"))
    counts = term_counter(words.where("_trains"), size)
    found, _ = stored(counts.transform(words).drop("_w", "_g", "_t"), "terms")
    model = counts_logistic(found.where("_trains"), label)
    return with_score(model.transform(found)).drop("_trains", "_c", "_i", "_v", "rawPrediction", "probability", "prediction")


def without_summary(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model as it is saved. A fresh one carries the summary of its training, which holds the session, and a session that has observed a query cannot be sent to tasks."""
    path = new_folder(SparkSession.active(), "model")
    model.save(path)
    return LogisticRegressionModel.load(path)


def scored_by(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the score of the positive class."""
    return with_score(model.transform(rows.withColumn("_w", tokens(F.col(text))))).select(*rows.columns, "score")


def with_score(found: DataFrame) -> DataFrame:
    return found.withColumn("score", vector_to_array("probability")[1])


def at_once(task: Callable, items: Iterable) -> list:
    """What ``task`` gives for each item, in their order; its Spark jobs run side by side."""
    items = list(items)
    with ThreadPool(max(1, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(task), items)


def out_of_fold(rows: DataFrame, fit: Callable[[DataFrame], object], score: Callable[[object, DataFrame], DataFrame]) -> DataFrame:
    """Validation rows of all folds (``rows`` with validates and trains) with the score of the model that their fold learnt, and the fold.

    A fold whose training or validation is empty, or whose training has one class only, is left out by ``fit`` returning None.
    """
    rows, _ = stored(rows, "folded")

    def run(fold: int) -> DataFrame | None:
        train, held = rows.where(F.col("trains") <= fold), rows.where(F.col("validates") == fold)
        model = None if held.isEmpty() else fit(train)
        return model and score(model, held).withColumn("fold", F.lit(fold))

    # Folds do not depend on one another, and their models' many short jobs leave most of a cluster idle: they run side by side.
    pooled = [found for found in at_once(run, range(1, len(FOLD_ENDS) + 1)) if found is not None]
    if not pooled:
        return rows.where("false").withColumns({"score": F.lit(0.0), "fold": F.lit(0)})
    return stored(reduce(DataFrame.unionByName, pooled), "out-of-fold")[0]


def precision_recall(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """(threshold, tp, fp, precision, recall, f1) of each score as threshold: rows that score at least as much are predicted."""
    counts = scored.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label)).cast("double").alias("_p"), F.count("*").cast("double").alias("_n"))
    run = running(counts, "threshold", ["_p", "_n"])
    total = counts.agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    tp, all_ = F.col("_tp") - F.col("_below__p"), F.col("_tn") - F.col("_below__n")
    found = run.join(F.broadcast(total)).select("threshold", tp.alias("tp"), (all_ - tp).alias("fp"), "_p", "_tp")
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.when(F.col("_tp") > 0, F.col("tp") / F.col("_tp")).otherwise(0.0)
    return found.select("threshold", "tp", "fp", p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"), "_p", "_tp")


def average_precision(scored: DataFrame, label: str, score: str = "score") -> DataFrame:
    """Area under the precision-recall curve, in steps: precision weighted by what recall each threshold adds."""
    curve = precision_recall(scored, label, score)
    return curve.agg(F.sum(F.when(F.col("_tp") > 0, F.col("precision") * F.col("_p") / F.col("_tp"))).alias("pr_auc"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """(threshold, f1): the threshold of the best F1 (to 12 digits), the least of several."""
    return curve.agg(F.max_by(F.struct("threshold", "f1"), F.struct(F.round("f1", 12), -F.col("threshold"))).alias("b")).select("b.threshold", "b.f1")


def report(scored: DataFrame, label: str, score: str, threshold: DataFrame) -> DataFrame:
    """One row of metrics at a threshold (a table of one row), and those that need none."""
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    held = F.greatest(F.lit(2.220446049250313e-16), F.least(F.lit(1 - 2.220446049250313e-16), p))
    at = scored.join(F.broadcast(threshold.select(F.col("threshold").alias("_t")))).withColumn("_hit", p >= F.col("_t"))
    cells = at.agg(
        F.count("*").alias("n"), F.first("_t").alias("threshold"), *[F.count_if((y == t) & (F.col("_hit") == F.lit(h))).alias(k) for k, t, h in (("tn", 0, False), ("fp", 0, True), ("fn", 1, False), ("tp", 1, True))],
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(held) + (1 - y) * F.log(1 - held))).alias("log_loss"),
    )
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    f1, f0 = safe(2 * tp, 2 * tp + fp + fn), safe(2 * tn, 2 * tn + fp + fn)
    whole = cells.select(
        "n", "threshold", "tn", "fp", "fn", "tp", safe(tp + tn, tp + tn + fp + fn).alias("accuracy"), ((safe(tp, tp + fn) + safe(tn, tn + fp)) / 2).alias("balanced_accuracy"), safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"), "brier", "log_loss",
    )
    return whole.join(F.broadcast(average_precision(scored, label, score))).join(F.broadcast(roc_auc(scored, label, score).withColumnRenamed("auc", "roc_auc")))


def reliability(scored: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate, gap) of the equal-width bins that have rows; a score on an edge, as a float, belongs above it."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double")))
    inner = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)[1:-1]]
    at = sum(((p >= e).cast("int") for e in inner), F.lit(1))
    g = scored.select(at.alias("bin"), p.alias("_p"), F.col(label).cast("double").alias("_y")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("_p").alias("mean_score"), F.avg("_y").alias("rate"))
    return g.withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))


def calibration_summary(scored: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """One row: expected and maximum calibration error, Brier score, and whether that passes, asks for review or says too little."""
    b = reliability(scored, label, score, bins)
    gaps = b.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score).cast("double")))
    brier = scored.agg(F.avg((p - F.col(label)) * (p - F.col(label))).alias("brier"), F.count_distinct(label).alias("_classes"))
    enough = (F.col("n") >= LEAST_CALIBRATION_ROWS) & (F.col("_classes") == 2)
    status = F.when(~enough, "insufficient_data").when(F.col("ece") <= WORST_ECE, "passed").otherwise("review_required")
    return gaps.join(F.broadcast(brier)).select("n", "ece", "mce", "brier", status.alias("status"))
