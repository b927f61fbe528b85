"""Operators on ordered series: latest rows, growth, smoothing, baselines, forecasts, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in that order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def superseded(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds whether a row is other than the first of its key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("superseded", F.row_number().over(w) > 1)


def growth(df: DataFrame, key: list[str], period: str, value: str, band: float = 0.05) -> DataFrame:
    """Change over the last two periods that are there, and its direction."""
    w = Window.partitionBy(*key).orderBy(F.desc(period))
    last = df.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    out = last.groupBy(*key).agg(F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("latest"), F.max(F.when(F.col("_rn") == 2, F.col(value))).alias("previous"))
    out = out.withColumn("growth", F.when(F.coalesce("previous", F.lit(0)) != 0, F.round((F.col("latest") - F.col("previous")) / F.col("previous"), 4)))
    return out.withColumn("direction", F.when(F.col("growth") > band, "rising").when(F.col("growth") < -band, "falling").otherwise("stable"))


def smoothed(df: DataFrame, key: list[str], period: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential smoothing, seeded by the first value; a fold over each series, which is as long as its periods."""
    series = F.transform(F.array_sort(F.collect_list(F.struct(period, value))), lambda x: x[value].cast("double"))
    out = df.groupBy(*key).agg(series.alias("v"))
    return out.select(*key, F.round(F.aggregate("v", F.get("v", F.lit(0)), lambda a, x: a * (1 - alpha) + x * alpha), 4).alias("level"))


def baselines(df: DataFrame, key: list[str], period: str, value: str, season: int = 12) -> DataFrame:
    """Forecasts of each value from those before it: last, mean of three, mean of all, season."""
    w = Window.partitionBy(*key).orderBy(period)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(*key, period, value, F.lag(value).over(w).alias("last"), F.avg(value).over(w.rowsBetween(-3, -1)).alias("mean3"), F.avg(value).over(before).alias("mean"), F.lag(value, season).over(w).alias("season"))


def trend(df: DataFrame, key: list[str], period_number: str, value: str) -> DataFrame:
    """Least-squares line through each series, one step on."""
    out = df.groupBy(*key).agg(F.regr_slope(value, period_number).alias("slope"), F.regr_intercept(value, period_number).alias("intercept"), F.max(period_number).alias("last"))
    return out.select(*key, F.round("slope", 6).alias("slope"), F.round(F.col("intercept") + F.col("slope") * (F.col("last") + 1), 4).alias("next"))


def recursive_forecast(df: DataFrame, key: list[str], period: str, value: str, steps: int, window: int = 3) -> DataFrame:
    """Each step is the mean of the last ``window`` values, forecasts included."""
    series = F.transform(F.array_sort(F.collect_list(F.struct(period, value))), lambda x: x[value].cast("double"))
    out = df.groupBy(*key).agg(series.alias("v"))
    more = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("v"), lambda a, _: F.concat(a, F.array(F.aggregate(F.slice(a, F.greatest(F.size(a) - window + 1, F.lit(1)), F.lit(window)), F.lit(0.0), lambda s, x: s + x) / F.least(F.size(a), F.lit(window)))))
    out = out.withColumn("all", more).select(*key, F.posexplode(F.slice("all", F.size("v") + 1, F.lit(steps))).alias("step", "forecast"))
    return out.select(*key, (F.col("step") + 1).alias("step"), F.round("forecast", 4).alias("forecast"))


def hash_split(df: DataFrame, id_column: str, seed: str = "42", train: int = 70, validation: int = 85) -> DataFrame:
    """Adds split by the first 8 hexadecimal digits of SHA-256(seed:id), modulo 100."""
    n = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.col(id_column).cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(n < train, "train").when(n < validation, "validation").otherwise("test"))


def filled_months(df: DataFrame, key: list[str], month: str, value: str) -> DataFrame:
    """Every month from the first to the last of all; 0 where a key has none."""
    ends = df.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    months = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias(month))
    grid = df.select(*key).distinct().join(F.broadcast(months))  # a row a month of the calendar
    return grid.join(df.select(*key, month, value), [*key, month], "left").fillna(0, [value])


def top_of(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key in that order; Spark keeps as many in each task before it shuffles."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def safe_boundary(rows: DataFrame, group: str, order: str, share: float) -> DataFrame:
    """(boundary, total, share): the number of first rows, nearest to that share, that no group stands across.

    Groups become intervals of ``order`` first, so what one task orders are groups, not rows.
    """
    groups = rows.groupBy(group).agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("a", group).rowsBetween(Window.unboundedPreceding, 0)
    cut = groups.select("b", F.sum("n").over(before).alias("boundary"), F.max("b").over(before).alias("last"), F.lead("a").over(Window.orderBy("a", group)).alias("next"), F.sum("n").over(Window.partitionBy()).alias("total"))
    cut = cut.where("next > last").select("boundary", "total", (F.col("boundary").cast("double") / F.col("total")).alias("share"))
    return cut.orderBy(F.abs(F.col("boundary") - F.col("total") * share), "boundary").limit(1)


def stratified(rows: DataFrame, stratum: str, key: str, take: int, seed: int = 0) -> DataFrame:
    """``take`` rows dealt evenly over the strata, one more for the first ones, by a seeded hash of the key."""
    strata = rows.select(stratum).distinct().withColumns({"_k": F.row_number().over(Window.orderBy(stratum)), "_s": F.count("*").over(Window.partitionBy())})
    own = strata.select(stratum, (F.floor(F.lit(take) / F.col("_s")) + F.when(F.col("_k") <= F.lit(take) % F.col("_s"), 1).otherwise(0)).alias("_take"))
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key)
    ranked = rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= take)
    return ranked.join(own, stratum).where("_rn <= _take").drop("_rn", "_take")
