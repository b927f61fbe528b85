"""Demand signals over the order tables: aggregates, series, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidloom.functions import dates, numbers
from evidloom.operators import series
from evidloom.plans.registry import query, table


def _monthly(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("n"))


_MONTHLY = "m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL)"


@query("demand_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, n_name AS region, count(*) AS demand, count(DISTINCT o_custkey) AS customers, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def demand_by_month(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.expr("c_nationkey = n_nationkey"))
    return j.groupBy(dates.month(F.col("o_orderdate")).alias("month"), F.col("n_name").alias("region")).agg(F.count("*").alias("demand"), F.count_distinct("o_custkey").alias("customers"), F.max("o_totalprice").alias("most"))


@query("global_profile", "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high, round(coalesce(avg(o_totalprice), 0), 4) AS mean, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM orders")
def global_profile(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 4).alias("mean"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("filtered_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 100000) AS large, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS open_mean FROM orders GROUP BY 1")
def filtered_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.round(F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))), 4).alias("open_mean"))


@query("top_suppliers", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20")
def top_suppliers(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue")).orderBy(F.desc("n"), "l_suppkey").limit(20)


@query("duplicate_groups", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query("indicator_signals", """SELECT p_type AS indicator, p_brand AS dimension, year(l_shipdate)::INT AS year, 'Q' || quarter(l_shipdate) AS quarter, round(avg(l_quantity), 4) AS value, count(*) AS evidence, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def indicator_signals(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    return j.groupBy(F.col("p_type").alias("indicator"), F.col("p_brand").alias("dimension"), F.year("l_shipdate").alias("year"), dates.quarter(F.col("l_shipdate")).alias("quarter")).agg(F.round(F.avg("l_quantity"), 4).alias("value"), F.count("*").alias("evidence"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("signal_scores", """WITH g AS (SELECT l_partkey, count(*) AS n, sum(l_discount::DECIMAL(18, 4))::DOUBLE / count(l_discount) AS conf FROM lineitem GROUP BY 1)
SELECT l_partkey, n, n::DOUBLE / (SELECT max(n) FROM g) AS demand, least(1.0::DOUBLE, 0.5::DOUBLE + 0.05::DOUBLE * n) * (1 - conf) AS confidence FROM g""")
def signal_scores(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), numbers.exact_mean("l_discount").alias("conf"))
    most = g.agg(F.max("n").alias("most"))
    return g.join(F.broadcast(most)).select("l_partkey", "n", (F.col("n").cast("double") / F.col("most")).alias("demand"), (F.least(F.lit(1.0), 0.5 + 0.05 * F.col("n")) * (1 - F.col("conf"))).alias("confidence"))


@query("demand_weights", "SELECT l_partkey, 1 + least(count(*) / 25.0, 1)::DOUBLE + 0.75::DOUBLE * (sum(l_tax::DECIMAL(18, 4))::DOUBLE / count(l_tax)) + 0.35::DOUBLE * (sum(l_discount::DECIMAL(18, 4))::DOUBLE / count(l_discount)) AS weight FROM lineitem GROUP BY 1")
def demand_weights(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg((1 + F.least(F.count("*") / 25.0, F.lit(1.0)) + 0.75 * numbers.exact_mean("l_tax") + 0.35 * numbers.exact_mean("l_discount")).alias("weight"))


@query("status_histogram", "SELECT c_mktsegment, o_orderstatus, count(*) AS n, max(o_totalprice) AS best FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def status_histogram(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))


@query("best_order_of_segment", """SELECT c_mktsegment, o_orderkey, o_totalprice FROM (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rn <= 8""")
def best_order_of_segment(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("c_mktsegment", "o_orderkey", "o_totalprice")


@query("latest_order", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_order(spark, sf):
    return series.keep_best(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus", F.lit(1).alias("rn"))


@query("earliest_order", "SELECT o_custkey, min(o_orderdate) AS first_date FROM orders GROUP BY 1")
def earliest_order(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"))


@query("superseded_orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) > 1 AS superseded FROM orders")
def superseded_orders(spark, sf):
    return series.superseded(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_totalprice"), F.desc("o_orderkey")]).select("o_orderkey", "superseded")


@query("growth", f"""WITH {_MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month DESC) AS rn FROM m),
g AS (SELECT o_orderpriority, max(n) FILTER (WHERE rn = 1) AS latest, max(n) FILTER (WHERE rn = 2) AS previous FROM r WHERE rn <= 2 GROUP BY 1), h AS (SELECT *, round((latest - previous)::DOUBLE / previous, 4) AS growth FROM g)
SELECT *, CASE WHEN growth > 0.05 THEN 'rising' WHEN growth < -0.05 THEN 'falling' ELSE 'stable' END AS direction FROM h""")
def growth(spark, sf):
    return series.growth(_monthly(spark, sf), ["o_orderpriority"], "month", "n")


@query("smoothed", f"WITH RECURSIVE {_MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) AS rn FROM m), s AS (SELECT o_orderpriority, rn, n::DOUBLE AS level FROM r WHERE rn = 1 UNION ALL SELECT r.o_orderpriority, r.rn, s.level * 0.7 + r.n * 0.3 FROM s JOIN r ON r.o_orderpriority = s.o_orderpriority AND r.rn = s.rn + 1) SELECT o_orderpriority, round(last(level ORDER BY rn), 4) AS level FROM s GROUP BY 1")
def smoothed(spark, sf):
    return series.smoothed(_monthly(spark, sf), ["o_orderpriority"], "month", "n")


@query("baselines", f"WITH {_MONTHLY} SELECT o_orderpriority, month::VARCHAR AS month, n, lag(n) OVER w AS last, round(avg(n) OVER (PARTITION BY o_orderpriority ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS mean3, round(avg(n) OVER (PARTITION BY o_orderpriority ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS mean, lag(n, 12) OVER w AS season FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)")
def baselines(spark, sf):
    out = series.baselines(_monthly(spark, sf), ["o_orderpriority"], "month", "n")
    return out.withColumns({"month": F.col("month").cast("string"), "mean3": F.round("mean3", 4), "mean": F.round("mean", 4)})


@query("trend", f"WITH {_MONTHLY}, k AS (SELECT o_orderpriority, (year(month) * 12 + month(month))::INT AS t, n FROM m), r AS (SELECT o_orderpriority, regr_slope(n, t) AS s, regr_intercept(n, t) AS i, max(t) AS last FROM k GROUP BY 1) SELECT o_orderpriority, round(s, 6) AS slope, round(i + s * (last + 1), 4) AS next FROM r")
def trend(spark, sf):
    m = _monthly(spark, sf).withColumn("t", F.year("month") * 12 + F.month("month"))
    return series.trend(m, ["o_orderpriority"], "t", "n")


@query("recursive_forecast", f"""WITH RECURSIVE {_MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month DESC) AS rn FROM m),
f AS (SELECT o_orderpriority, 0 AS step, max(n::DOUBLE) FILTER (WHERE rn = 3) AS a, max(n::DOUBLE) FILTER (WHERE rn = 2) AS b, max(n::DOUBLE) FILTER (WHERE rn = 1) AS c FROM r GROUP BY 1
UNION ALL SELECT o_orderpriority, step + 1, b, c, (a + b + c) / 3 FROM f WHERE step < 6) SELECT o_orderpriority, step, round(c, 4) AS forecast FROM f WHERE step > 0""")
def recursive_forecast(spark, sf):
    return series.recursive_forecast(_monthly(spark, sf), ["o_orderpriority"], "month", "n", 6)


@query("filled_months", """WITH d AS (SELECT n_name, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
t AS (SELECT unnest(generate_series((SELECT min(month) FROM d), (SELECT max(month) FROM d), INTERVAL 1 MONTH))::DATE AS month)
SELECT k.n_name, t.month::VARCHAR AS month, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT n_name FROM d) k CROSS JOIN t LEFT JOIN d ON d.n_name = k.n_name AND d.month = t.month""")
def filled_months(spark, sf):
    j = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.expr("c_nationkey = n_nationkey"))
    d = j.groupBy("n_name", F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("n"))
    return series.filled_months(d, ["n_name"], "month", "n").select("n_name", F.col("month").cast("string").alias("month"), "n")


@query("hash_split", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN k < 70 THEN 'train' WHEN k < 85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT ('0x' || substr(sha256('42:' || o_orderkey), 1, 8))::BIGINT % 100 AS k FROM orders)) GROUP BY 1")
def hash_split(spark, sf):
    return series.hash_split(table(spark, sf, "orders"), "o_orderkey").groupBy("split").agg(F.count("*").alias("n"))


@query("chronological_split", "WITH g AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1), r AS (SELECT o_custkey, percent_rank() OVER (ORDER BY first, o_custkey) AS p FROM g) SELECT CASE WHEN p < 0.8 THEN 'train' ELSE 'holdout' END AS part, count(*) AS n FROM r GROUP BY 1")
def chronological_split(spark, sf):
    """Groups by their first date: the earliest four fifths train. The rank is found by counting over ranges of dates."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"))
    days = g.groupBy(F.to_date("first").alias("day")).agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a day
    total = days.agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy("first", "o_custkey")) - 1
    r = g.withColumn("day", F.to_date("first")).withColumn("rank", rank).join(before.select("day", "before"), "day").join(F.broadcast(total))
    part = F.when((F.col("before") + F.col("rank")) / F.greatest(F.col("total") - 1, F.lit(1)) < 0.8, "train").otherwise("holdout")
    return r.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query("expanding_folds", "WITH g AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS month FROM orders), f AS (SELECT month, ntile(4) OVER (ORDER BY month)::INT AS fold FROM g) SELECT f.fold, count(*) AS n, min(o_orderdate) AS first FROM orders JOIN f ON date_trunc('month', o_orderdate)::DATE = f.month GROUP BY 1")
def expanding_folds(spark, sf):
    o = table(spark, sf, "orders").withColumn("month", F.date_trunc("month", "o_orderdate").cast("date"))
    folds = o.select("month").distinct().withColumn("fold", F.ntile(4).over(Window.orderBy("month")))  # a row a month
    return o.join(F.broadcast(folds), "month").groupBy("fold").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"))


@query("price_bands", "SELECT CASE WHEN o_totalprice >= 150000 THEN 'very_high' WHEN o_totalprice >= 80000 THEN 'high' WHEN o_totalprice >= 30000 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1")
def price_bands(spark, sf):
    return table(spark, sf, "orders").groupBy(numbers.band(F.col("o_totalprice"), [(30000, "medium"), (80000, "high"), (150000, "very_high")], "low").alias("band")).agg(F.count("*").alias("n"))


@query("paged_orders", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged_orders(spark, sf):
    o = table(spark, sf, "orders")
    page = o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)
    return page.join(F.broadcast(o.agg(F.count("*").alias("total"))))


@query("recent_window_top", "SELECT l_returnflag, count(*) AS n FROM (SELECT * FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 1000) GROUP BY 1")
def recent_window_top(spark, sf):
    return table(spark, sf, "lineitem").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(1000).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("priority_scores", """SELECT l_partkey, round(greatest(0.0, least(1.0, avg(l_discount) * 10 * 0.34 + least(1.0, count(*) / 30.0) * 0.20 + avg(l_tax) * 10 * 0.20 + 0.5 * 0.10 + 1.0 * 0.16)), 4) AS priority FROM lineitem GROUP BY 1""")
def priority_scores(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg((F.avg("l_discount") * 10).alias("gap"), F.least(F.lit(1.0), F.count("*") / 30.0).alias("evidence"), (F.avg("l_tax") * 10).alias("demand"))
    return g.select("l_partkey", numbers.priority(F.col("gap"), F.col("evidence"), F.col("demand"), F.lit(0.5), F.lit(1.0)).alias("priority"))


@query("period_regularity", f"WITH {_MONTHLY} SELECT o_orderpriority, count(*) AS periods, (date_diff('month', min(month), max(month)) + 1)::BIGINT AS expected, count(*) = date_diff('month', min(month), max(month)) + 1 AS regular FROM m GROUP BY 1")
def period_regularity(spark, sf):
    g = _monthly(spark, sf).groupBy("o_orderpriority").agg(F.count("*").alias("periods"), (F.months_between(F.max("month"), F.min("month")) + 1).cast("long").alias("expected"))
    return g.withColumn("regular", F.col("periods") == F.col("expected"))


@query("rolling_up", "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def rolling_up(spark, sf):
    return table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.expr("c_nationkey = n_nationkey")).rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"))
