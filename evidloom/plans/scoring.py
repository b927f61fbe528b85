"""Scores that rank gaps and recommendations, features of mappings, errors of forecasts, review queues and tasks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from evidloom.functions import extract, numbers, text
from evidloom.operators import quality, series
from evidloom.plans.registry import query, table

_FACTS = """f AS (SELECT p_partkey, count(l_orderkey) AS labour, count(*) FILTER (WHERE l_quantity > 35) AS taught, coalesce(sum(l_discount::DECIMAL(18, 4))::DOUBLE / count(l_discount), 0) * 10 AS confidence,
  count(*) FILTER (WHERE l_shipdate >= DATE '1998-01-01')::DOUBLE AS late FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1),
g AS (SELECT p_partkey, labour, taught, CASE WHEN labour > 0 THEN taught::DOUBLE / labour ELSE 0 END AS coverage, least(1, confidence) AS confidence, least(1, labour / 25.0::DOUBLE) AS evidence, labour::DOUBLE / (SELECT max(labour) FROM f) AS demand, CASE WHEN labour > 0 THEN late / labour ELSE 0 END AS forecast FROM f)"""


def _facts(spark, sf):
    j = table(spark, sf, "part").select("p_partkey").join(table(spark, sf, "lineitem"), F.expr("p_partkey = l_partkey"), "left")
    f = j.groupBy("p_partkey").agg(F.count("l_orderkey").alias("labour"), F.count_if(F.col("l_quantity") > 35).alias("taught"), (F.coalesce(numbers.exact_mean("l_discount"), F.lit(0.0)) * 10).alias("c"), F.count_if(F.col("l_shipdate") >= F.lit("1998-01-01").cast("date")).cast("double").alias("late"))
    most = f.agg(F.max("labour").alias("most"))
    share = lambda c: F.when(F.col("labour") > 0, F.col(c).cast("double") / F.col("labour")).otherwise(0.0)
    return f.join(F.broadcast(most)).select(
        "p_partkey", "labour", "taught", share("taught").alias("coverage"), F.least(F.lit(1.0), "c").alias("confidence"), F.least(F.lit(1.0), F.col("labour") / 25.0).alias("evidence"), (F.col("labour").cast("double") / F.col("most")).alias("demand"), share("late").alias("forecast"),
    )


@query("gap_priorities", f"WITH {_FACTS} SELECT p_partkey, CASE WHEN labour = 0 THEN 'unmatched' WHEN taught = 0 THEN 'missing' WHEN coverage < 0.3 THEN 'weak' ELSE 'covered' END AS kind, round(0.40 * (1 - coverage) + 0.25 * evidence + 0.25 * demand + 0.10 * confidence, 4) AS priority FROM g")
def gap_priorities(spark, sf):
    """What is asked for and not taught, by how urgent that is."""
    f = _facts(spark, sf).withColumn("gap", 1 - F.col("coverage"))
    kind = F.when(F.col("labour") == 0, "unmatched").when(F.col("taught") == 0, "missing").when(F.col("coverage") < 0.3, "weak").otherwise("covered")
    return f.select("p_partkey", kind.alias("kind"), F.round(numbers.weighted(numbers.GAP_PRIORITY), 4).alias("priority"))


@query("ranking_refresh", f"WITH {_FACTS}, s AS (SELECT p_partkey, round(least(1, 0.30 * (1 - coverage) + 0.25 * demand + 0.15 * forecast + 0.15 * evidence + 0.15 * confidence), 4) AS score FROM g) SELECT *, CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.42 THEN 'medium' ELSE 'low' END AS priority FROM s")
def ranking_refresh(spark, sf):
    """The score of each recommendation as its evidence now stands."""
    f = _facts(spark, sf).withColumn("gap", 1 - F.col("coverage"))
    s = f.select("p_partkey", F.round(F.least(F.lit(1.0), numbers.weighted(numbers.RANKING)), 4).alias("score"))
    return s.withColumn("priority", F.when(F.col("score") >= 0.72, "high").when(F.col("score") >= 0.42, "medium").otherwise("low"))


@query("forecast_errors", """WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT o_orderpriority, month, n::DOUBLE AS y, lag(n) OVER w::DOUBLE AS p FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)),
s AS (SELECT *, lag(y) OVER w AS y0, lag(p) OVER w AS p0 FROM r WHERE p IS NOT NULL WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month))
SELECT o_orderpriority, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(100 * avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-8)), 6) AS smape, round(100 * avg(abs(y - p) / abs(y)), 6) AS mape, round(avg((sign(y - y0) = sign(p - p0))::INT) FILTER (WHERE y0 IS NOT NULL), 6) AS direction FROM s GROUP BY 1""")
def forecast_errors(spark, sf):
    """How wrong the month before is as a forecast of each month."""
    m = table(spark, sf, "orders").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    r = m.withColumn("p", F.lag("n").over(Window.partitionBy("o_orderpriority").orderBy("month"))).where("p IS NOT NULL")
    out = quality.forecast_report(r, "o_orderpriority", "month", "n", "p")
    return out.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "smape", "mape", "direction")])


_SOURCES = {"source_urgent": "urgent|high", "source_low": "^5"}
_REGIONS = {"region_america": "america", "region_a": "^a"}


@query("training_features", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, c_name || ' ' || p_name || ' ' || p_type AS description, p_name AS title, lower(p_type) AS matched, o_totalprice AS salary, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CASE WHEN l_discount > 0 THEN l_discount * 10 END AS conf, lower(o_orderpriority) AS source, lower(r_name) AS region
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(title || ' ' || description), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(matched, '[a-z0-9]+')) AS b FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(length(description) / 4000.0::DOUBLE + 2 * (length(title) / 200.0::DOUBLE) + 3 * (length(matched) / 120.0::DOUBLE), 9) AS sizes, contains(lower(description), matched)::INT::DOUBLE AS desc_match, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS token_overlap, round(least(1, coalesce(conf, 0.5)), 6) AS confidence,
  regexp_matches(source, 'urgent|high')::INT::DOUBLE AS source_urgent, regexp_matches(source, '^5')::INT::DOUBLE AS source_low, regexp_matches(region, 'america')::INT::DOUBLE AS region_america, regexp_matches(region, '^a')::INT::DOUBLE AS region_a, round(least(1, salary / 200000.0::DOUBLE), 9) AS salary_mid_norm, round(greatest(0, least(1, (y - 2000) / 40.0)), 6) AS year_norm, q / 4.0 AS quarter_norm, (l_extendedprice > 0)::INT::DOUBLE AS is_processed FROM w""")
def training_features(spark, sf):
    """What a line tells of its order as a posting: sizes, overlaps, flags of source and region, money and time."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    j = j.join(F.broadcast(table(spark, sf, "nation")), F.expr("c_nationkey = n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.expr("n_regionkey = r_regionkey"))
    given = {
        "description": F.concat_ws(" ", "c_name", "p_name", "p_type"), "title": F.col("p_name"), "matched": F.lower("p_type"), "evidence_len": F.lit(None).cast("double"), "salary_mid": F.col("o_totalprice"), "year": F.year("o_orderdate"), "quarter": F.quarter("o_orderdate"),
        "confidence": F.when(F.col("l_discount") > 0, F.col("l_discount") * 10), "source": F.col("o_orderpriority"), "region": F.col("r_name"), "employment": F.col("l_returnflag"), "skills": F.lit(None).cast("double"), "processed": F.col("l_extendedprice") > 0, "method": F.lit(None).cast("string"),
    }
    x = extract.training_features(given, _SOURCES, _REGIONS)
    sizes = F.round(x["posting_len"] + 2 * x["title_len"] + 3 * x["matched_len"], 9)
    shown = ["token_overlap", "confidence", "year_norm"]
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sizes.alias("sizes"), F.round(x["salary_mid_norm"], 9).alias("salary_mid_norm"), *[F.round(x[c], 6).alias(c) for c in shown], *[x[c].alias(c) for c in ("desc_match", *_SOURCES, *_REGIONS, "quarter_norm", "is_processed")])


_TASKS = "lineitem JOIN part ON l_partkey = p_partkey"


@query("tasks_by_granularity", f"""WITH g AS (SELECT p_brand, l_partkey, year(l_shipdate) AS y, count(*) AS n FROM {_TASKS} GROUP BY ALL), s AS (SELECT p_brand, l_partkey, sum(n) AS n FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, l_partkey) AS rn FROM s),
t AS (SELECT DISTINCT 'subject' AS level, p_brand AS unit FROM g UNION ALL SELECT 'signal', p_brand || '|' || l_partkey FROM r WHERE rn <= 20 UNION ALL SELECT DISTINCT 'period', p_brand || '|' || y FROM g UNION ALL SELECT 'window', p_brand || '|' || md5(string_agg(l_partkey::VARCHAR, ',' ORDER BY rn)) FROM r WHERE rn <= 20 GROUP BY p_brand)
SELECT level, unit, sha256(level || '|' || unit) AS task_key FROM t""")
def tasks_by_granularity(spark, sf):
    """Review tasks a subject, a signal (the twenty greatest), a period, and a window of signals, named by hashes so that a rerun adds none."""
    g = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey")).groupBy("p_brand", "l_partkey", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))
    signals = g.groupBy("p_brand", "l_partkey").agg(F.sum("n").alias("n"))
    top = series.top_of(signals, ["p_brand"], [F.desc("n"), "l_partkey"], 20)
    window = top.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "l_partkey"))).alias("x"))
    parts = [
        g.select(F.lit("subject").alias("level"), F.col("p_brand").alias("unit")).distinct(), top.select(F.lit("signal").alias("level"), F.concat_ws("|", "p_brand", "l_partkey").alias("unit")),
        g.select(F.lit("period").alias("level"), F.concat_ws("|", "p_brand", "y").alias("unit")).distinct(), window.select(F.lit("window").alias("level"), F.concat_ws("|", "p_brand", F.md5(F.array_join(F.transform("x", lambda x: x["l_partkey"].cast("string")), ","))).alias("unit")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.withColumn("task_key", F.sha2(F.concat_ws("|", "level", "unit"), 256))


@query("alias_queue", """WITH a AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS alias FROM part), u AS (SELECT alias, count(DISTINCT p_partkey) AS parts FROM a GROUP BY 1)
SELECT alias, parts, CASE WHEN length(alias) < 4 THEN 'too_short' WHEN parts > (SELECT count(*) / 20.0 FROM part) THEN 'ambiguous' END AS reason FROM u WHERE length(alias) < 4 OR parts > (SELECT count(*) / 20.0 FROM part) ORDER BY parts DESC, alias LIMIT 100""")
def alias_queue(spark, sf):
    """Words of names that say too little: short ones, and those of more than a twentieth of all parts; the commonest hundred."""
    p = table(spark, sf, "part")
    used = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("alias")).distinct().groupBy("alias").agg(F.count("*").alias("parts"))
    held = used.join(F.broadcast(p.agg((F.count("*") / 20).alias("most"))))
    reason = F.when(F.length("alias") < 4, "too_short").when(F.col("parts") > F.col("most"), "ambiguous")
    return held.select("alias", "parts", reason.alias("reason")).where("reason IS NOT NULL").orderBy(F.desc("parts"), "alias").limit(100)


@query("duplicate_queue", r"""WITH k AS (SELECT c_custkey, c_nationkey, c_mktsegment, round(c_acctbal, -2) AS balance FROM customer), g AS (SELECT *, count(*) OVER w AS n, min(c_custkey) OVER w AS keep FROM k WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, balance))
SELECT keep, c_custkey AS merge, n FROM g WHERE n > 1 AND c_custkey <> keep""")
def duplicate_queue(spark, sf):
    """Customers of one nation, segment and rounded balance, each beside the first of them."""
    k = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.round("c_acctbal", -2).alias("balance"))
    keys = ["c_nationkey", "c_mktsegment", "balance"]
    first = k.groupBy(*keys).agg(F.min("c_custkey").alias("keep"), F.count("*").alias("n")).where("n > 1")
    return k.join(first, keys).where("c_custkey <> keep").select("keep", F.col("c_custkey").alias("merge"), "n")


@query("cleaned_postings", r"""WITH j AS (SELECT o_orderkey, c_name, n_name, r_name, o_orderpriority, o_orderstatus, o_totalprice, o_orderdate, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT o_orderkey, trim(regexp_replace(regexp_replace(lower(c_mktsegment || ' ' || o_orderpriority), '\b(senior|junior|lead|principal|graduate|intern|trainee|entry level|mid level)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS normalised_title, lower(n_name) AS city, NULL::VARCHAR AS region, r_name AS country, CASE o_orderstatus WHEN 'F' THEN 'full_time' WHEN 'O' THEN 'contract' END AS employment,
  o_totalprice * 0.9 AS salary_min, o_totalprice * 1.1 AS salary_max, round((o_totalprice * 0.9 + o_totalprice * 1.1) / 2, 4) AS salary_midpoint, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'medium' WHEN o_totalprice < 400000 THEN 'high' ELSE 'very_high' END AS band, strftime(o_orderdate, '%Y-%m-%d') AS posted_date, year(o_orderdate)::INT AS year, 'Q' || quarter(o_orderdate) AS quarter,
  sha256(lower(c_name) || '|' || lower(n_name) || '|' || strftime(o_orderdate, '%Y-%m-%d')) AS fingerprint FROM j""")
def cleaned_postings(spark, sf):
    """Orders as postings in their canonical form: title, nested location, employment, salary, dates and fingerprint."""
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).join(F.broadcast(table(spark, sf, "nation")), F.expr("c_nationkey = n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.expr("n_regionkey = r_regionkey"))
    place = text.location(F.concat_ws(", ", F.lower("n_name"), "r_name"))
    posted, total = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice")
    low, high = total * 0.9, total * 1.1
    band = F.when(total < 100_000, "low").when(total < 250_000, "medium").when(total < 400_000, "high").otherwise("very_high")
    return j.withColumn("place", place).select(
        "o_orderkey", text.job_title(F.concat_ws(" ", "c_mktsegment", "o_orderpriority")).alias("normalised_title"), "place.city", "place.region", "place.country", F.when(F.col("o_orderstatus") == "F", "full_time").when(F.col("o_orderstatus") == "O", "contract").alias("employment"),
        low.alias("salary_min"), high.alias("salary_max"), F.round((low + high) / 2, 4).alias("salary_midpoint"), band.alias("band"), posted.alias("posted_date"), F.year("o_orderdate").alias("year"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("quarter"), text.fingerprint(F.col("c_name"), F.col("n_name"), posted).alias("fingerprint"),
    )
