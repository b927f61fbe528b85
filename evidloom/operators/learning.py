"""Term weights and gaps, scaling, collinearity, forecasts by lags, intervals by resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidloom.functions.text import tokens
from evidloom.tables import stored

#: Common words that carry no topic.
STOP = ("the", "of", "and", "to", "in", "is", "it", "an", "on", "at", "by", "for", "with", "as", "or", "that", "this", "are", "be", "was")


def text_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of each word of two or more letters or digits that is no stop word."""
    words = F.filter(tokens(F.col(text), r"\b\w\w+\b"), lambda w: ~w.isin(*STOP))
    return docs.select(key, F.explode(words).alias("term"))


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n) of words of two or more letters or digits that are no stop words."""
    return text_terms(docs, key, text).groupBy(key, "term").agg(F.count("*").alias("n"))


def common_counts(docs: DataFrame, key: str, text: str, n_docs: DataFrame, size: int = 256, max_df: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The ``vocabulary`` of all terms, and ``term_counts`` of the most common terms, which hold it; both written.

    Terms are first counted without their keys. Only the most common of them, twice as many as the
    vocabulary has room for, are counted for each key; more where the vocabulary is not full because so
    many are in too many documents.
    """
    words = text_terms(docs, key, text)
    totals, _ = stored(words.groupBy("term").agg(F.count("*").alias("total")), "totals")
    tried = 2 * size
    while True:
        among, _ = stored(totals.orderBy(F.desc("total"), "term").limit(tried).select("term"), "among")
        counts, _ = stored(words.join(F.broadcast(among), "term").groupBy(key, "term").agg(F.count("*").alias("n")), "terms")
        found, _ = stored(vocabulary(counts, n_docs, size, max_df), "vocabulary")
        if found.count() == size or among.count() < tried:
            return counts, found
        tried *= 4


def vocabulary(counts: DataFrame, n_docs: DataFrame, size: int = 256, max_df: float = 0.95) -> DataFrame:
    """(term, df, n_docs) of the ``size`` most common terms that at most that share of documents has; ``n_docs`` is one row."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).join(F.broadcast(n_docs))
    return df.where(F.col("df") <= max_df * F.col("n_docs")).orderBy(F.desc("total"), "term").limit(size).select("term", "df", "n_docs")


def tfidf(counts: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """(key, term, weight): counts times smooth inverse frequency, of unit length for each key. The vocabulary has a fixed size."""
    idf = F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1
    raw = counts.join(F.broadcast(vocabulary), "term").select(key, "term", (F.col("n") * idf).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))  # a row a term of the vocabulary
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"))


def gaps(weights: DataFrame, key: str, demand: DataFrame) -> DataFrame:
    """(key, gap): one less the cosine with ``demand`` (term, weight), held to 0 and 1; demand has a row a term of the vocabulary."""
    d = demand.select("term", F.col("weight").alias("d"))
    norm = d.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("dn"))
    own = weights.join(F.broadcast(d), "term", "left").groupBy(key).agg(F.sum(F.col("weight") * F.coalesce("d", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    return own.join(F.broadcast(norm)).select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("dot") / (F.col("n") * F.col("dn")))).alias("gap"))


def with_missing(weights: DataFrame, key: str, demand: DataFrame, most: int) -> DataFrame:
    """``weights`` with the ``most`` terms of the greatest demand that a key lacks, as they are in demand. Demand has a row a term of the vocabulary."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term")))
    wanted = demand.agg(order.alias("_order")).select(F.col("_order.term").alias("_wanted"), F.map_from_arrays("_order.term", F.transform("_order.w", lambda w: -w)).alias("_demand"))
    own = weights.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("_own")).join(F.broadcast(wanted))
    lacks = F.slice(F.array_except("_wanted", F.col("_own.term")), 1, most)
    added = F.transform(lacks, lambda t: F.struct(t.alias("term"), F.col("_demand")[t].alias("weight")))
    return own.select(key, F.inline(F.concat("_own", added)))


def scenario(skills: DataFrame, key: str, add: list[str], drop: list[str], demand: DataFrame, unknown: float = 0.1) -> DataFrame:
    """(key, before, after): mean demand of a key's skills as they are, and with some added and some dropped."""
    lit = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    arrays = skills.groupBy(key).agg(F.collect_set("skill").alias("s"))
    rows = arrays.select(key, F.explode(F.array(F.struct(F.lit("before").alias("k"), F.col("s").alias("s")), F.struct(F.lit("after").alias("k"), F.array_except(F.array_union("s", lit(add)), lit(drop)).alias("s")))).alias("x")).select(key, "x.k", F.explode("x.s").alias("skill"))
    value = F.coalesce(F.col("demand").cast("decimal(18,4)"), F.lit(unknown).cast("decimal(18,4)"))
    return rows.join(demand, "skill", "left").groupBy(key).pivot("k", ["before", "after"]).agg(F.sum(value).cast("double") / F.count("skill"))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their deviation (of the population); a constant one becomes 0."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = rows.join(F.broadcast(stats))
    return out.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}).select(rows.columns)


def min_max(rows: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns scaled by least and greatest value of the training rows alone; others may fall outside 0 and 1."""
    stats = rows.where(train).agg(*[F.min(c).alias(f"_a_{c}") for c in columns], *[F.max(c).alias(f"_b_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"_b_{c}") > F.col(f"_a_{c}"), (F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_b_{c}") - F.col(f"_a_{c}"))).otherwise(0.0) for c in columns}
    return rows.join(F.broadcast(stats)).withColumns(scaled).select(rows.columns)


def inflation(rows: DataFrame, columns: list[str], most: float = 5.0) -> DataFrame:
    """(feature, vif, kept): variance inflation by the inverse of the correlations; infinite for a constant or dependent column."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(rows).select("_v")
    r = Correlation.corr(vectors, "_v").head()[0].toArray()  # of a row a feature
    constant = [len(columns) > 1 and np.isnan(np.delete(r[i], i)).all() for i in range(len(columns))]
    r = np.nan_to_num(r, nan=0.0)
    out = []
    for i, c in enumerate(columns):
        others = [j for j in range(len(columns)) if j != i]
        x, y = r[np.ix_(others, others)], r[others, i]
        r2 = float(y @ np.linalg.pinv(x) @ y) if not constant[i] else 1.0
        vif = float("inf") if r2 >= 0.999 else 1 / (1 - r2)
        out.append((c, vif, vif < most))
    return rows.sparkSession.createDataFrame(out, "feature string, vif double, kept boolean")


def lag_rows(series: DataFrame, key: str, period: str, value: str, lags: int) -> DataFrame:
    """(key, period, lags, target): each value beside the ``lags`` before it, where there are as many."""
    before = Window.partitionBy(key).orderBy(period).rowsBetween(-lags, -1)
    return series.withColumn("lags", F.collect_list(value).over(before)).where(F.size("lags") == lags).select(key, period, "lags", F.col(value).alias("target"))


def regular(series: DataFrame, key: str, period: str, value: str) -> DataFrame:
    """(key, reason): why a monthly series cannot be evaluated, null where it can."""
    months = F.months_between(F.max(period), F.min(period)) + 1
    g = series.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(period).alias("d"), months.alias("m"), F.min(value).alias("a"), F.max(value).alias("b"))
    return g.select(key, F.when((F.col("n") != F.col("m")) | (F.col("n") != F.col("d")), "mixed_or_irregular_periods").when(F.col("a") == F.col("b"), "constant_or_zero_series").alias("reason"))


def rolling_origin(series: DataFrame, key: str, period: str, value: str, lags: int = 3, season: int = 12, least: int = 24, penalty: float = 1.0) -> DataFrame:
    """(key, model, rmse, n) of one-step forecasts from each origin after ``least`` periods, by values before it alone.

    Models are ridge autoregression, last value, the value a season ago, and drift. A series is one
    group, of a row a period.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(period)[value].to_numpy(float)
        errors: dict[str, list[float]] = {m: [] for m in ("ridge", "last", "seasonal", "drift")}
        for t in range(least, len(y)):
            past = y[:t]
            x = np.stack([past[i - lags : i] for i in range(lags, t)])
            x1, mean = np.column_stack([np.ones(len(x)), x]), np.diag([0.0] + [penalty] * lags)
            w = np.linalg.solve(x1.T @ x1 + mean, x1.T @ past[lags:])
            guess = {"ridge": w[0] + past[-lags:] @ w[1:], "last": past[-1], "seasonal": past[-season], "drift": past[-1] + (past[-1] - past[0]) / (t - 1)}
            for m, g in guess.items():
                errors[m].append(y[t] - g)
        rows = [(pdf[key].iloc[0], m, float(np.sqrt(np.mean(np.square(e)))), len(e)) for m, e in errors.items() if e]
        return pd.DataFrame(rows, columns=[key, "model", "rmse", "n"])

    kind = series.schema[key].dataType.simpleString()
    return series.select(key, period, value).groupBy(key).applyInPandas(run, f"{key} {kind}, model string, rmse double, n long")


def best_baseline(scores: DataFrame, key: str, model: str, rmse: str, candidate: str) -> DataFrame:
    """(key, baseline, baseline_rmse, improvement): the best of the other models, and by what share the candidate is better."""
    base = scores.where(F.col(model) != candidate).groupBy(key).agg(F.min(F.struct(F.col(rmse), F.col(model))).alias("b"))
    own = scores.where(F.col(model) == candidate).select(key, F.col(rmse).alias("_own"))
    out = base.join(own, key).select(key, F.col("b")[model].alias("baseline"), F.col("b")[rmse].alias("baseline_rmse"), "_own")
    return out.withColumn("improvement", F.when(F.col("baseline_rmse") > 0, (F.col("baseline_rmse") - F.col("_own")) / F.col("baseline_rmse"))).drop("_own")


def bootstrap(values: DataFrame, value: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """(low, high): the 2.5 and 97.5 percentiles, by nearest rank, of means of resampled rows.

    ``values`` is an aggregate (a row a day, say): it is numbered in one task, and each of its rows is
    drawn ``replicates`` times by a seeded hash.
    """
    numbered = values.withColumn("_i", F.row_number().over(Window.orderBy(*[c for c in values.columns])) - 1)
    n = values.agg(F.count("*").alias("_n"))
    draws = numbered.select(F.col("_i").alias("_k")).join(F.broadcast(n)).select("_n", "_k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r"))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_r", "_k").cast("binary")), 1, 8), 16, 10).cast("long"), F.col("_n"))
    means = draws.withColumn("_i", pick).join(numbered.select("_i", value), "_i").groupBy("_r").agg((F.sum(value).cast("double") / F.count("*")).alias("m"))
    ranked = means.withColumn("_rank", F.row_number().over(Window.orderBy("m", "_r")))  # a row a replicate
    at = lambda q: F.max(F.when(F.col("_rank") == max(1, -(-int(q * replicates * 10) // 10000)), F.col("m")))
    return ranked.agg(at(25).alias("low"), at(975).alias("high"))


def boosted(rows: DataFrame, features: list[str], label: str, train: Column, seed: int = 1) -> tuple[DataFrame, list[tuple[str, float]]]:
    """``rows`` with a score by boosted trees learnt from the training rows, and the importance of each feature."""
    vectors = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep").transform(rows)
    model = GBTClassifier(featuresCol="_v", labelCol=label, maxIter=15, maxDepth=3, seed=seed).fit(vectors.where(train))
    out = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    return out.select(*rows.columns, "score"), list(zip(features, map(float, model.featureImportances.toArray()), strict=True))


def threshold_sweep(scored: DataFrame, label: str, low: int = 25, high: int = 75, step: int = 5) -> DataFrame:
    """(threshold, f1) of each threshold in per cent; scores are first counted by per cent and label."""
    binned = scored.groupBy(F.floor(F.col("score") * 100 / step).alias("_b"), label).agg(F.count("*").alias("n"))
    tried = binned.withColumn("threshold", F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(step))))
    hit = F.col("_b") * step >= F.col("threshold")
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = tried.groupBy("threshold").agg(of(hit & (F.col(label) == 1)).alias("tp"), of(hit & (F.col(label) == 0)).alias("fp"), of(~hit & (F.col(label) == 1)).alias("fn"))
    return out.select("threshold", F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0).alias("f1"))
