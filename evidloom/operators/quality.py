"""Data-quality rules, scores, metrics of classifiers and drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidloom.tables import stored


@dataclass(frozen=True)
class Rule:
    """A named check; ``passes`` is a SQL condition, null counts as failed."""

    name: str
    passes: str
    severity: str = "fail"  # or error, or warn


PENALTY = {"error": 0.35, "fail": 0.20, "warn": 0.10}


def checked(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """A row for each rule that a row breaks."""
    broken = F.array(*[F.when(~F.coalesce(F.expr(r.passes), F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules])
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("x")).select(key, "x.rule", "x.severity")


def quality_score(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """1 less the penalties of broken rules, not under 0, and the status that follows."""
    ok = lambda r: F.coalesce(F.expr(r.passes), F.lit(False))
    lost = sum((F.when(ok(r), 0.0).otherwise(PENALTY[r.severity]) for r in rules), F.lit(0.0))
    hard = [~ok(r) for r in rules if r.severity != "warn"]
    soft = [~ok(r) for r in rules if r.severity == "warn"]
    any_of = lambda cs: F.array_max(F.array(F.lit(False), *cs))
    return df.select(key, F.round(F.greatest(F.lit(0.0), 1 - lost), 4).alias("score"), F.when(any_of(hard), "failed").when(any_of(soft), "warning").otherwise("valid").alias("status"))


def first_reason(checks: list[tuple[str, str]]) -> Column:
    """The name of the first condition that does not hold; null where all do."""
    out = F.lit(None).cast("string")
    for name, passes in reversed(checks):
        out = F.when(~F.coalesce(F.expr(passes), F.lit(False)), name).otherwise(out)
    return out


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Cells of the two-class table, zeros filled in."""
    cells = [F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(n) for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    return df.agg(*cells)


def binary_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    c = confusion(df, truth, predicted)
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    return c.select("tn", "fp", "fn", "tp", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(safe(2 * p * r, p + r), 4).alias("f1"), F.round(safe(tp + tn, tp + tn + fp + fn), 4).alias("accuracy"), F.round((r + safe(tn, tn + fp)) / 2, 4).alias("balanced"))


def running(g: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``g``, a row a value of ``order``, with the sum of each column over lesser values as ``_below_`` and its name.

    Rows are dealt by ranges of as many rows; sums are taken by range first (a row a range), then within each, so no task orders all values.
    """
    binned, _ = stored(g.repartitionByRange(order).withColumn("_bin", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy("_bin").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    sums = sums.select("_bin", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0.0)).alias(f"_t_{c}") for c in columns])
    within = Window.partitionBy("_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(F.broadcast(sums), "_bin").withColumns({f"_below_{c}": F.col(f"_t_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0.0)) for c in columns})
    return out.drop("_bin", *[f"_t_{c}" for c in columns])


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks; ties share their rank. Scores are counted first, so a common score is one row."""
    g = df.groupBy(F.col(score).alias("_score")).agg(F.sum(F.col(truth)).cast("double").alias("p"), (F.count("*") - F.sum(F.col(truth))).cast("double").alias("q"))
    g = running(g, "_score", ["q"])
    return g.select("p", "q", (F.col("p") * (F.col("_below_q") + F.col("q") / 2)).alias("w")).agg(F.round(F.sum("w") / (F.sum("p") * F.sum("q")), 4).alias("auc"))


def calibration(df: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    """Equal-width bins: rows, mean score, rate and gap."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("mean_score"), F.round(F.avg(truth), 4).alias("rate"))
    return g.withColumn("gap", F.round(F.abs(F.col("mean_score") - F.col("rate")), 4))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("rb"))
    expected = rows.join(cols, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0.0)).alias("e"))
    totals = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("o"))
    k = (F.col("o") / F.col("t") - F.col("e") / (F.col("t") * F.col("t"))) / (1 - F.col("e") / (F.col("t") * F.col("t")))
    return totals.join(F.broadcast(expected)).select(F.col("t").cast("long").alias("n"), F.round(k, 4).alias("kappa"))


def ks_statistic(df: DataFrame, group: str, value: str) -> DataFrame:
    """Greatest distance of the distributions of two groups (0 and 1). Values are counted first."""
    g = df.groupBy(F.col(value).alias("_value")).agg(F.sum(F.when(F.col(group) == 0, 1.0).otherwise(0.0)).alias("a"), F.sum(F.when(F.col(group) == 1, 1.0).otherwise(0.0)).alias("b"))
    total = g.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    run = running(g, "_value", ["a", "b"]).select((F.col("_below_a") + F.col("a")).alias("ca"), (F.col("_below_b") + F.col("b")).alias("cb")).join(F.broadcast(total))
    return run.agg(F.round(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))), 4).alias("ks"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e = F.col(truth) - F.col(predicted)
    return df.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(F.when(F.abs(F.col(truth)) + F.abs(F.col(predicted)) > 0, 2 * F.abs(e) / (F.abs(F.col(truth)) + F.abs(F.col(predicted)))).otherwise(0.0)), 4).alias("smape"))


def forecast_report(df: DataFrame, group: str, order: str, truth: str, predicted: str) -> DataFrame:
    """(group, n, mae, rmse, smape, mape, direction) of each series, in per cent but for the first two.

    mape leaves rows out of which the truth is 0 (null if all are); direction is the share of steps in which both move the same way.
    """
    w = Window.partitionBy(group).orderBy(order)
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    rows = df.select(group, y.alias("_y"), p.alias("_p"), F.lag(y).over(w).alias("_y0"), F.lag(p).over(w).alias("_p0"))
    e = F.abs(F.col("_y") - F.col("_p"))
    same = F.when(F.col("_y0").isNotNull(), (F.signum(F.col("_y") - F.col("_y0")) == F.signum(F.col("_p") - F.col("_p0"))).cast("double"))
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(2 * e / (F.abs("_y") + F.abs("_p") + F.lit(1e-8)))).alias("smape"),
        (100 * F.avg(F.when(F.abs("_y") > 1e-8, e / F.abs("_y")))).alias("mape"), F.avg(same).alias("direction"),
    )


def nearest_rank(df: DataFrame, group: str | None, value: str, share: float) -> DataFrame:
    """(group, value): the least value that at least that share of a group's rows does not exceed.

    Values are counted first and dealt by ranges of group and value, then summed a range, and only
    the values of the range in which the rank falls are ordered. So no task holds a group's values.
    """
    keys = [group] if group else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    dealt, _ = stored(counts.repartitionByRange(*keys, value).withColumn("_bin", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"))  # a row a group and range
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("_rank", F.ceil(F.sum("_m").over(w) * F.lit(share))).withColumn("_before", F.coalesce(F.sum("_m").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = sums.where("_before < _rank AND _before + _m >= _rank").select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_bin", "_before", "_rank")
    same = [F.col(f"_k_{k}").eqNullSafe(F.col(k)) for k in keys]
    inside = dealt.alias("d").join(at.withColumnRenamed("_bin", "_at"), [F.col("_bin") == F.col("_at"), *same])
    run = F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy(value)) + F.col("_before")
    return inside.withColumn("_run", run).where("_run >= _rank").groupBy(*keys).agg(F.min(value).alias(value))


def percentile(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row: the percentile of a column, between its two nearest values where none stands there, as ``value``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").cast("double").alias("n"))
    run = running(counts, "v", ["n"])
    at = run.join(F.broadcast(counts.agg(((F.sum("n") - 1) * F.lit(share)).alias("_at"))))
    low, high = (F.min(F.when(F.col("_below_n") + F.col("n") > f("_at"), F.col("v"))) for f in (F.floor, F.ceil))
    return at.agg(low.alias("a"), high.alias("b"), F.first("_at").alias("_at")).select((F.col("a") + (F.col("b") - F.col("a")) * (F.col("_at") - F.floor("_at"))).alias(value))


def winsorised(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Columns held between one pair of percentiles over all of them together."""
    pooled = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v"))
    ends = percentile(pooled, "v", low).withColumnRenamed("v", "_lo").join(F.broadcast(percentile(pooled, "v", high).withColumnRenamed("v", "_hi")))
    return df.join(F.broadcast(ends)).withColumns({c: F.greatest("_lo", F.least("_hi", F.col(c).cast("double"))) for c in columns}).drop("_lo", "_hi")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("_n"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_n", "_rn")


def snapshot_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and an order-free digest of a table: fingerprints of rows, summed."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), (F.sum(h) % F.lit(2**53).cast("decimal(38,0)")).cast("long").alias("digest"))
