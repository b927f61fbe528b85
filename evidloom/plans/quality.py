"""Quality rules, evaluation metrics and governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.operators import quality
from evidloom.operators.quality import Rule
from evidloom.plans.registry import query, table

ORDER_RULES = [
    Rule("has_status", "o_orderstatus IS NOT NULL AND o_orderstatus <> ''", "error"),
    Rule("open_or_done", "o_orderstatus IN ('O', 'F')"),
    Rule("least_price", "o_totalprice >= 5000"),
    Rule("recent", "o_orderdate >= DATE '1996-01-01'", "warn"),
]
_CHECKS = "(o_orderstatus IS NOT NULL AND o_orderstatus <> '') AS c1, o_orderstatus IN ('O', 'F') AS c2, o_totalprice >= 5000 AS c3, o_orderdate >= DATE '1996-01-01' AS c4"


@query("broken_rules", f"WITH c AS (SELECT o_orderkey, {_CHECKS} FROM orders) SELECT o_orderkey, r.rule, r.severity FROM c, LATERAL (SELECT unnest([{{'rule': 'has_status', 'severity': 'error', 'ok': c1}}, {{'rule': 'open_or_done', 'severity': 'fail', 'ok': c2}}, {{'rule': 'least_price', 'severity': 'fail', 'ok': c3}}, {{'rule': 'recent', 'severity': 'warn', 'ok': c4}}]) AS r) WHERE NOT r.ok")
def broken_rules(spark, sf):
    return quality.checked(table(spark, sf, "orders"), "o_orderkey", ORDER_RULES)


@query("quality_scores", f"WITH c AS (SELECT o_orderkey, {_CHECKS} FROM orders) SELECT o_orderkey, round(greatest(0, 1 - (CASE WHEN c1 THEN 0 ELSE 0.35 END + CASE WHEN c2 THEN 0 ELSE 0.2 END + CASE WHEN c3 THEN 0 ELSE 0.2 END + CASE WHEN c4 THEN 0 ELSE 0.1 END)), 4)::DOUBLE AS score, CASE WHEN NOT (c1 AND c2 AND c3) THEN 'failed' WHEN NOT c4 THEN 'warning' ELSE 'valid' END AS status FROM c")
def quality_scores(spark, sf):
    return quality.quality_score(table(spark, sf, "orders"), "o_orderkey", ORDER_RULES)


@query("quality_rollup", f"WITH c AS (SELECT o_orderpriority, {_CHECKS} FROM orders) SELECT o_orderpriority, CASE WHEN NOT (c1 AND c2 AND c3) THEN 'failed' WHEN NOT c4 THEN 'warning' ELSE 'valid' END AS status, count(*) AS n FROM c GROUP BY ALL")
def quality_rollup(spark, sf):
    o = table(spark, sf, "orders")
    s = quality.quality_score(o, "o_orderkey", ORDER_RULES)
    return s.join(o.select("o_orderkey", "o_orderpriority"), "o_orderkey").groupBy("o_orderpriority", "status").agg(F.count("*").alias("n"))


@query("eligibility", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'no_text' WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN source = 'src0' THEN 'source' END AS reason, CASE WHEN text IS NULL OR text = '' OR n_chars < 200 OR lang <> 'en' OR source = 'src0' THEN false ELSE true END AS included FROM documents")
def eligibility(spark, sf):
    r = quality.first_reason([("no_text", "text IS NOT NULL AND text <> ''"), ("short", "n_chars >= 200"), ("language", "lang = 'en'"), ("source", "source <> 'src0'")])
    return table(spark, sf, "documents").select("doc_id", r.alias("reason"), r.isNull().alias("included"))


def _predicted(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return d.select("doc_id", "lang", "quality", "toxic", F.when((F.instr("text", "!!") == 0) & (F.instr("text", "***") == 0), 1).otherwise(0).alias("pred"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))


_PRED = "p AS (SELECT doc_id, lang, quality, toxic, CASE WHEN strpos(text, '!!') = 0 AND strpos(text, '***') = 0 THEN 1 ELSE 0 END AS pred, least(1.0, n_chars / 4000.0)::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


@query("binary_metrics", f"WITH {_PRED}, c AS (SELECT count(*) FILTER (WHERE quality = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND pred = 1) AS tp FROM p) SELECT tn, fp, fn, tp, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS balanced FROM c")
def binary_metrics(spark, sf):
    return quality.binary_metrics(_predicted(spark, sf), "quality", "pred")


@query("roc_auc", f"WITH {_PRED}, g AS (SELECT score, sum(quality) AS p, count(*) - sum(quality) AS q FROM p GROUP BY 1), r AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS w FROM g) SELECT round((sum(w) / (sum(p) * sum(q)))::DOUBLE, 4) AS auc FROM r")
def roc_auc(spark, sf):
    return quality.roc_auc(_predicted(spark, sf), "quality", "score")


@query("calibration_bins", f"WITH {_PRED}, g AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 4) AS mean_score, round(avg(quality), 4) AS rate FROM p GROUP BY 1) SELECT *, round(abs(mean_score - rate), 4) AS gap FROM g")
def calibration_bins(spark, sf):
    return quality.calibration(_predicted(spark, sf), "quality", "score")


@query("rater_agreement", f"WITH {_PRED}, t AS (SELECT count(*)::DOUBLE AS n, sum((quality = pred)::INT) AS o, sum(quality) AS a, sum(pred) AS b FROM p), k AS (SELECT n, o / n AS po, (a * b + (n - a) * (n - b)) / (n * n) AS pe FROM t) SELECT n::BIGINT AS n, round((po - pe) / (1 - pe), 4) AS kappa FROM k")
def rater_agreement(spark, sf):
    return quality.kappa(_predicted(spark, sf), "quality", "pred")


@query("drift", f"WITH {_PRED}, t AS (SELECT sum((toxic = 0)::INT)::DOUBLE AS ta, sum((toxic = 1)::INT)::DOUBLE AS tb FROM p), g AS (SELECT score, sum((toxic = 0)::INT) AS a, sum((toxic = 1)::INT) AS b FROM p GROUP BY 1), r AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM g WINDOW w AS (ORDER BY score ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(ca / ta - cb / tb)), 4) AS ks FROM r, t")
def drift(spark, sf):
    return quality.ks_statistic(_predicted(spark, sf), "toxic", "score")


@query("subgroup_rates", f"WITH {_PRED}, g AS (SELECT lang, count(*) AS n, avg(pred) AS r FROM p GROUP BY 1) SELECT lang, n, round(r, 4) AS rate, round(r - (SELECT max(r) FROM g), 4) AS below_best FROM g")
def subgroup_rates(spark, sf):
    g = _predicted(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.avg("pred").alias("r"))
    best = g.agg(F.max("r").alias("best"))
    return g.join(F.broadcast(best)).select("lang", "n", F.round("r", 4).alias("rate"), F.round(F.col("r") - F.col("best"), 4).alias("below_best"))


@query("regression_metrics", "SELECT count(*) AS n, round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) AS mae, round(sqrt(avg((l_extendedprice - l_quantity * 1000) ** 2)), 4) AS rmse, round(avg(2 * abs(l_extendedprice - l_quantity * 1000) / (abs(l_extendedprice) + abs(l_quantity * 1000))), 4) AS smape FROM lineitem")
def regression_metrics(spark, sf):
    return quality.regression_metrics(table(spark, sf, "lineitem").withColumn("guess", F.expr("l_quantity * 1000")), "l_extendedprice", "guess")


@query("threshold_sweep", f"WITH {_PRED} SELECT t / 100.0::DOUBLE AS threshold, count(*) FILTER (WHERE score * 100 >= t) AS chosen, count(*) FILTER (WHERE score * 100 >= t AND quality = 1) AS right_ones FROM p, (SELECT unnest(range(35, 90, 5)) AS t) GROUP BY t")
def threshold_sweep(spark, sf):
    p = _predicted(spark, sf)
    steps = range(35, 90, 5)
    wide = p.agg(*[F.count_if(F.col("score") * 100 >= t).alias(f"c{t}") for t in steps], *[F.count_if((F.col("score") * 100 >= t) & (F.col("quality") == 1)).alias(f"r{t}") for t in steps])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(t / 100.0).alias("threshold"), F.col(f"c{t}").alias("chosen"), F.col(f"r{t}").alias("right_ones")) for t in steps])).alias("x")).select("x.*")


@query("winsorised", "WITH v AS (SELECT unnest([l_quantity, l_discount * 100]) AS v FROM lineitem), e AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM v) SELECT l_returnflag, round(sum(greatest(lo, least(hi, l_quantity))), 4) AS quantity, round(sum(greatest(lo, least(hi, l_discount * 100))), 4) AS discount FROM lineitem, e GROUP BY 1")
def winsorised(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") * 100).alias("discount"))
    return quality.winsorised(d, ["l_quantity", "discount"]).groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 4).alias("quantity"), F.round(F.sum("discount"), 4).alias("discount"))


@query("freshness", "WITH s AS (SELECT o_custkey, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1), n AS (SELECT max(last) AS now FROM s) SELECT CASE WHEN o_custkey IS NULL THEN 'never' WHEN date_diff('day', last, now) > 180 THEN 'stale' ELSE 'fresh' END AS state, count(*) AS n FROM customer LEFT JOIN s ON c_custkey = o_custkey, n GROUP BY 1")
def freshness(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last"))
    now = s.agg(F.max("last").alias("now"))
    j = table(spark, sf, "customer").join(s, F.expr("c_custkey = o_custkey"), "left").join(F.broadcast(now))
    return j.groupBy(F.when(F.col("o_custkey").isNull(), "never").when(F.datediff("now", "last") > 180, "stale").otherwise("fresh").alias("state")).agg(F.count("*").alias("n"))


@query("upserted", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) THEN 'REVIEWED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upserted(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    new = table(spark, sf, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"), F.lit("REVIEWED").alias("c_mktsegment")).distinct()
    return quality.upserted(c, new, "c_custkey")


@query("snapshot_hash", "SELECT count(*) AS n, (sum(('0x' || substr(sha256(c_custkey || '|' || c_name), 1, 12))::HUGEINT) % 9007199254740992)::BIGINT AS digest FROM customer")
def snapshot_hash(spark, sf):
    return quality.snapshot_hash(table(spark, sf, "customer"), ["c_custkey", "c_name"])


@query("leakage", "SELECT count(*) AS shared FROM (SELECT md5(text) AS h FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT md5(text) FROM documents WHERE doc_id % 5 <> 0)")
def leakage(spark, sf):
    d = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("h"), (F.col("doc_id") % 5 == 0).alias("test"))
    return d.groupBy("h").agg(F.max("test").alias("a"), F.min("test").alias("b")).agg(F.count_if(F.col("a") & ~F.col("b")).alias("shared"))


@query("missing_shares", "SELECT round(avg((lang IS NULL)::INT), 4) AS lang, round(avg((source IS NULL)::INT), 4) AS source, round(avg((text IS NULL OR text = '')::INT), 4) AS text FROM documents")
def missing_shares(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return table(spark, sf, "documents").agg(share(F.col("lang").isNull()).alias("lang"), share(F.col("source").isNull()).alias("source"), share(F.col("text").isNull() | (F.col("text") == "")).alias("text"))


@query("balanced_selection", "SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR)) AS rn FROM labels) WHERE rn <= 20")
def balanced_selection(spark, sf):
    """Up to twenty of each class, in an order that a hash makes."""
    h = table(spark, sf, "labels").select("doc_id", "toxic", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    parts = [h.where(F.col("toxic") == v).orderBy("h").limit(20) for v in (0, 1)]
    return parts[0].union(parts[1]).select("doc_id", "toxic")
