"""Signals of demand, their evidence, and the inputs of recommendations.

Every table of facts is aggregated by its key before anything is joined or ranked; totals that
all rows need are one broadcast row.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from evidloom.functions import dates
from evidloom.functions.numbers import exact_mean
from evidloom.operators import evidence, series
from evidloom.plans.registry import query, table


def _lines(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))


_LINES = "lineitem JOIN part ON l_partkey = p_partkey"
_MEAN = "sum({0}::DECIMAL(18, 4))::DOUBLE / count({0})"


@query("skill_signals", f"""WITH f AS (SELECT p_brand AS skill, year(l_shipdate)::INT AS year, 'Q' || quarter(l_shipdate) AS quarter, l_returnflag AS flag, count(*) AS n, sum(l_discount::DECIMAL(18, 4)) AS conf, bool_and(l_quantity > 1) AS all_ok, bool_or(l_tax > 0.07) AS any_high FROM {_LINES} GROUP BY ALL),
g AS (SELECT skill, year, quarter, sum(n)::BIGINT AS evidence, string_agg(flag || ':' || n, ',' ORDER BY flag) AS sources, sum(conf)::DOUBLE / sum(n) AS confidence, bool_and(all_ok) AS all_reviewed, bool_or(any_high) AS any_high FROM f GROUP BY ALL)
SELECT *, evidence::DOUBLE / (SELECT max(evidence) FROM g) AS demand FROM g""")
def skill_signals(spark, sf):
    """Signals by skill, year and quarter: evidence, histogram of sources, mean confidence, flags; demand is relative to the largest."""
    lines = _lines(spark, sf).select(F.col("p_brand").alias("skill"), F.year("l_shipdate").alias("year"), dates.quarter(F.col("l_shipdate")).alias("quarter"), F.col("l_returnflag").alias("source"), F.col("l_discount").alias("confidence"), (F.col("l_quantity") > 1).alias("reviewed"), (F.col("l_tax") > 0.07).alias("high"))
    out = evidence.signals(lines, ["skill", "year", "quarter"], "source", "confidence", all_of="reviewed", any_of="high")
    return out.withColumnsRenamed({"all_of": "all_reviewed", "any_of": "any_high"})


@query("weighted_demand", f"""WITH r AS (SELECT p_brand, l_quantity, l_discount, row_number() OVER (PARTITION BY p_brand ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM {_LINES}),
w AS (SELECT p_brand, l_quantity::DECIMAL(12, 2) AS x, greatest(l_discount::DECIMAL(12, 2), 0.01) AS w FROM r WHERE rn <= 100)
SELECT p_brand, sum(x * w)::DOUBLE / sum(w)::DOUBLE AS demand FROM w GROUP BY 1""")
def weighted_demand(spark, sf):
    """Mean of the 100 best rows of a skill, weighted by confidence of .01 at least."""
    best = series.top_of(_lines(spark, sf), ["p_brand"], [F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], 100)
    x, w = F.col("l_quantity").cast("decimal(12,2)"), F.greatest(F.col("l_discount").cast("decimal(12,2)"), F.lit("0.01").cast("decimal(12,2)"))
    return best.groupBy("p_brand").agg((F.sum(x * w).cast("double") / F.sum(w).cast("double")).alias("demand"))


@query("demand_summary", f"""WITH g AS (SELECT p_brand, l_partkey, sum(l_quantity::BIGINT)::BIGINT AS q FROM {_LINES} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY q DESC, l_partkey) AS rn FROM g)
SELECT p_brand, count(*) AS parts, sum(q)::DOUBLE / count(*) AS mean_demand, string_agg(l_partkey || ':' || q, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS top FROM r GROUP BY 1""")
def demand_summary(spark, sf):
    """Keys of a skill, their mean demand, and the five greatest."""
    g = _lines(spark, sf).groupBy("p_brand", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    all_ = g.groupBy("p_brand").agg(F.count("*").alias("parts"), (F.sum("q").cast("double") / F.count("*")).alias("mean_demand"))
    top = series.top_of(g, ["p_brand"], [F.desc("q"), "l_partkey"], 5).groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct((-F.col("q")).alias("k"), "l_partkey", "q"))).alias("x"))
    return all_.join(top, "p_brand").select("p_brand", "parts", "mean_demand", F.array_join(F.transform("x", lambda t: F.concat_ws(":", t["l_partkey"], t["q"])), ",").alias("top"))


@query("signal_totals", "SELECT coalesce(o_orderpriority, 'all') AS dimension, count(*) AS n, sum(o_totalprice::DECIMAL(18, 4))::DOUBLE / count(*) AS mean FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority))")
def signal_totals(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupingSets([[], ["o_orderpriority"]], "o_orderpriority").agg(F.count("*").alias("n"), exact_mean("o_totalprice").alias("mean")).select(F.coalesce("o_orderpriority", F.lit("all")).alias("dimension"), "n", "mean")


@query("observation_window", """WITH k AS (SELECT DISTINCT event_type, unnest(json_keys(props)) AS k FROM events), s AS (SELECT event_type, string_agg(k, ',' ORDER BY k) AS keys FROM k GROUP BY 1)
SELECT e.event_type, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day, min(year(ts))::INT AS first_year, max(year(ts))::INT AS last_year, any_value(keys) AS keys FROM events e JOIN s ON e.event_type = s.event_type GROUP BY 1""")
def observation_window(spark, sf):
    e = table(spark, sf, "events")
    keys = e.select("event_type", F.explode(F.json_object_keys("props")).alias("k")).distinct().groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keys"))
    days = e.groupBy("event_type").agg(F.to_date(F.min("ts")).cast("string").alias("first_day"), F.to_date(F.max("ts")).cast("string").alias("last_day"), F.min(F.year("ts")).alias("first_year"), F.max(F.year("ts")).alias("last_year"))
    return days.join(keys, "event_type")


@query("evidence_gaps", f"""WITH u AS (SELECT p_brand AS skill, l_discount::DECIMAL(18, 4) AS demand, l_tax::DECIMAL(18, 4) AS confidence FROM {_LINES} UNION ALL SELECT p_brand, (p_size / 500.0)::DECIMAL(18, 4), 0.1 FROM part),
m AS (SELECT skill, count(*) AS n, sum(demand)::DOUBLE / count(*) AS demand, sum(confidence)::DOUBLE / count(*) AS confidence FROM u GROUP BY 1) SELECT *, CASE WHEN demand >= 0.05 THEN 'gap' ELSE 'coverage' END AS kind FROM m""")
def evidence_gaps(spark, sf):
    """Mean demand and confidence of a skill over signals and evidence together."""
    kind = lambda c: c.cast("decimal(18,4)")
    signals = _lines(spark, sf).select(F.col("p_brand").alias("skill"), kind(F.col("l_discount")).alias("demand"), kind(F.col("l_tax")).alias("confidence"))
    other = table(spark, sf, "part").select(F.col("p_brand").alias("skill"), kind(F.col("p_size") / F.lit(500.0)).alias("demand"), kind(F.lit(0.1)).alias("confidence"))
    return evidence.mean_of_union(signals, other, "skill", threshold=0.05)


@query("label_distribution", "SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS zeros, count(*) FILTER (WHERE quality = 1) AS ones, sum(quality)::DOUBLE / count(*) AS mean, sum(abs(quality - toxic))::DOUBLE / count(*) AS mean_difference FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def label_distribution(spark, sf):
    """Labels of each source, and how far two raters stand apart in the mean."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    n = F.count("*")
    return j.groupBy("source").agg(n.alias("n"), F.count_if(F.col("quality") == 0).alias("zeros"), F.count_if(F.col("quality") == 1).alias("ones"), (F.sum("quality").cast("double") / n).alias("mean"), (F.sum(F.abs(F.col("quality") - F.col("toxic"))).cast("double") / n).alias("mean_difference"))


@query("proxy_errors", f"""WITH r AS (SELECT p_brand, abs(l_quantity - p_size)::BIGINT AS e, row_number() OVER (PARTITION BY p_brand ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS rn FROM {_LINES})
SELECT p_brand, sum(e)::DOUBLE / count(*) AS mean_error, count(*) FILTER (WHERE e <= 5) AS near, count(*) FILTER (WHERE e > 20) AS far FROM r WHERE rn <= 100 GROUP BY 1""")
def proxy_errors(spark, sf):
    """Errors of a proxy over the first 100 rows of a group."""
    r = series.top_of(_lines(spark, sf), ["p_brand"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"], 100)
    e = F.abs(F.col("l_quantity") - F.col("p_size")).cast("long")
    return r.groupBy("p_brand").agg((F.sum(e).cast("double") / F.count("*")).alias("mean_error"), F.count_if(e <= 5).alias("near"), F.count_if(e > 20).alias("far"))


@query("code_lengths", "SELECT coalesce(length(trim(p_type))::VARCHAR, 'total') AS size, count(*) AS n FROM part GROUP BY ROLLUP (length(trim(p_type)))")
def code_lengths(spark, sf):
    p = table(spark, sf, "part").select(F.length(F.trim("p_type")).alias("k"))
    return p.rollup("k").agg(F.count("*").alias("n")).select(F.coalesce(F.col("k").cast("string"), F.lit("total")).alias("size"), "n")


@query("scope_context", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents), g AS (SELECT lang, source, count(*) AS n FROM r WHERE rn <= 500 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM g)
SELECT lang, CASE WHEN count(*) = 1 THEN 'single' ELSE 'programme' END AS scope, string_agg(source || ':' || n, ',' ORDER BY rank) FILTER (WHERE rank <= 8) AS top FROM t GROUP BY 1""")
def scope_context(spark, sf):
    """Sources of the first 500 documents of a language: the eight most common, and whether there is but one."""
    first = series.top_of(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang"], ["doc_id"], 500)
    g = first.groupBy("lang", "source").agg(F.count("*").alias("n"))
    t = g.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source")))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= 8, F.struct("rank", F.concat_ws(":", "source", "n").alias("x")))))
    return t.groupBy("lang").agg(F.when(F.count("*") == 1, "single").otherwise("programme").alias("scope"), F.array_join(F.transform(top, lambda x: x["x"]), ",").alias("top"))


@query("received_landed", """WITH r AS (SELECT source AS file, count(*) AS received FROM documents GROUP BY 1), l AS (SELECT source AS file, count(*) AS landed FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1)
SELECT r.file, received, landed, received - coalesce(landed, 0) AS shortfall, received = landed AS reconciles FROM r LEFT JOIN l ON r.file = l.file""")
def received_landed(spark, sf):
    """Rows received and landed of each file; ``reconciles`` is null where nothing landed."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"))
    return evidence.reconciled(d, d.join(table(spark, sf, "labels"), "doc_id", "left_semi"), "file")


@query("resolved_links", "SELECT DISTINCT p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def resolved_links(spark, sf):
    """Links of which both ends are known, once each; links are made distinct before names are looked up."""
    links = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    out = links.join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey")).join(table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey"))
    return out.select("p_name", "s_name").distinct()


@query("rule_matches", """WITH s AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last, p_name FROM part),
k AS (SELECT DISTINCT p_brand AS skill, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last, p_name FROM part WHERE p_size = 1),
m AS (SELECT p_partkey, skill, 1 AS rule, 0.90 AS w FROM s JOIN k ON s.p_name = k.p_name UNION ALL SELECT p_partkey, skill, 2, 0.72 FROM s JOIN k ON s.last = k.last UNION ALL SELECT p_partkey, skill, 3, 0.66 FROM s JOIN k ON s.first = k.first)
SELECT p_partkey, skill, rule::INT AS rule, w::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, skill ORDER BY rule) AS rn FROM m) WHERE rn = 1""")
def rule_matches(spark, sf):
    """Signals matched with skills by ordered rules, each a join on a key, not a loop over all pairs; the first rule that fits holds."""
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    part = table(spark, sf, "part").withColumns({"first": word(1), "last": word(2)})
    skills = part.where("p_size = 1").select(F.col("p_brand").alias("skill"), "first", "last", "p_name").distinct()
    return evidence.by_rules(part, skills, "p_partkey", "skill", [("p_name", 0.90), ("last", 0.72), ("first", 0.66)])


@query("embedded_texts", "SELECT e.vec_id AS doc_id, e.label, d.lang, length(d.text) AS size FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
def embedded_texts(spark, sf):
    e, d = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), table(spark, sf, "documents")
    return e.join(d, "doc_id").select("doc_id", "label", "lang", F.length("text").cast("long").alias("size"))


@query("labelled_profiles", """WITH r AS (SELECT lower(source) AS name, doc_id, quality, row_number() OVER (PARTITION BY lower(source) ORDER BY doc_id) AS rn FROM labels JOIN documents USING (doc_id))
SELECT name, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE rn <= 5) AS first_ids FROM r GROUP BY 1""")
def labelled_profiles(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.lower("source").alias("name")), "doc_id")
    first = series.top_of(j, ["name"], ["doc_id"], 5).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("first_ids"))
    return j.groupBy("name").agg(F.count("*").alias("n")).join(first, "name")


@query("candidate_context", """SELECT p_partkey, coalesce(lines, 0) AS lines, coalesce(suppliers, 0) AS suppliers, coalesce(returns, 0) AS returns, coalesce(urgent, 0) AS urgent, last_day FROM part
LEFT JOIN (SELECT l_partkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_returnflag = 'R') AS returns, max(l_shipdate)::DATE::VARCHAR AS last_day FROM lineitem GROUP BY 1) a ON p_partkey = a.l_partkey
LEFT JOIN (SELECT l_partkey, count(*) AS urgent FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1) b ON p_partkey = b.l_partkey""")
def candidate_context(spark, sf):
    """What is known of each candidate: lookups by its key, aggregated before they are joined."""
    lines = table(spark, sf, "lineitem")
    a = lines.groupBy("l_partkey").agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_returnflag") == "R").alias("returns"), F.to_date(F.max("l_shipdate")).cast("string").alias("last_day"))
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    b = lines.select("l_orderkey", "l_partkey").join(urgent, F.expr("l_orderkey = o_orderkey")).groupBy("l_partkey").agg(F.count("*").alias("urgent"))
    return evidence.context(table(spark, sf, "part").select("p_partkey"), "p_partkey", [(a, "l_partkey"), (b, "l_partkey")]).fillna(0, ["lines", "suppliers", "returns", "urgent"])


@query("zero_evidence", """SELECT p_partkey, p_brand, count(l_orderkey) AS lines, count(l_orderkey) FILTER (WHERE l_returnflag = 'R' AND l_discount >= 0.1) AS strong, count(l_orderkey) FILTER (WHERE l_returnflag = 'R' AND l_discount >= 0.1) > 0 AS may_pass FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL""")
def zero_evidence(spark, sf):
    """The gate of recommendations: none passes without evidence of its own."""
    strong = F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.1))
    a = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("lines"), strong.alias("strong"))
    return evidence.context(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey", [(a, "l_partkey")]).fillna(0, ["lines", "strong"]).withColumn("may_pass", F.col("strong") > 0)


@query("recommendations", f"""WITH g AS (SELECT p_brand, l_partkey, count(*) AS evidence, sum(l_discount::DECIMAL(18, 4))::DOUBLE / count(*) AS demand, max(l_tax) AS confidence FROM {_LINES} GROUP BY ALL),
s AS (SELECT *, 0.40 * demand + 0.25 * least(evidence / 50.0, 1)::DOUBLE + 0.35 * confidence AS priority FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY priority DESC, l_partkey) AS rank FROM s)
SELECT p_brand, l_partkey, evidence, priority, rank FROM r WHERE rank <= 10 AND evidence > 0""")
def recommendations(spark, sf):
    """The ten candidates of each group of the highest priority that have evidence."""
    g = _lines(spark, sf).groupBy("p_brand", "l_partkey").agg(F.count("*").alias("evidence"), exact_mean("l_discount").alias("demand"), F.max("l_tax").alias("confidence"))
    return evidence.recommended(g, ["p_brand"], "l_partkey", {"demand": 0.40, "evidence": 0.25, "confidence": 0.35}, full_evidence=50.0, most=10)


@query("lineage_edges", """WITH o AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
SELECT DISTINCT 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b, 'placed' AS kind FROM o UNION ALL SELECT DISTINCT 'order:' || o_orderkey, 'part:' || l_partkey, 'holds' FROM o JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'made by' FROM o JOIN lineitem ON l_orderkey = o_orderkey""")
def lineage_edges(spark, sf):
    """The edges of the lineage of a scope of signals."""
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    held = o.join(table(spark, sf, "lineitem"), F.expr("l_orderkey = o_orderkey"))
    return evidence.edges([(o, "customer", "o_custkey", "order", "o_orderkey", "placed"), (held, "order", "o_orderkey", "part", "l_partkey", "holds"), (held, "part", "l_partkey", "supplier", "l_suppkey", "made by")])


@query("regional_mappings", """SELECT c_custkey, n_name, o_orderkey, o_orderstatus FROM orders JOIN customer ON o_orderstatus IN ('F', 'P') AND o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name ILIKE '%a%1' OR n_name ILIKE 'nation_2%' OR n_name ILIKE '%0'""")
def regional_mappings(spark, sf):
    """A join on a list of kinds and a key, kept where the region is like one of several patterns."""
    nation = table(spark, sf, "nation")
    near = evidence.any_like(F.col("n_name"), ["%a%1", "nation_2%", "%0"])
    o = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P"))
    return o.join(table(spark, sf, "customer").join(F.broadcast(nation.where(near)), F.expr("c_nationkey = n_nationkey")), F.expr("o_custkey = c_custkey")).select("c_custkey", "n_name", "o_orderkey", "o_orderstatus")


@query("scoped_or_all", """WITH f AS (SELECT *, o_orderstatus = 'P' AND o_totalprice > 300000 AS own FROM orders), g AS (SELECT *, bool_or(own) OVER (PARTITION BY o_custkey) AS any_own FROM f) SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM g WHERE own OR NOT any_own GROUP BY 1""")
def scoped_or_all(spark, sf):
    """Rows within the scope of each key, or all of the key where none is."""
    o = table(spark, sf, "orders").withColumn("own", (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000))
    return evidence.scoped_or_all(o, "o_custkey", "own").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("review_units", f"""WITH t AS (SELECT p_brand, count(*) AS n FROM {_LINES} GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 20), x AS (SELECT DISTINCT n_name, p_brand FROM {_LINES} JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity >= 49)
SELECT n_name, t.p_brand, t.n FROM nation, t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.n_name = nation.n_name AND x.p_brand = t.p_brand) ORDER BY n DESC, t.p_brand, n_name LIMIT 300""")
def review_units(spark, sf):
    """Decisions to be taken: pieces of evidence with the 20 greatest signals, but those taken already; a stated number of them."""
    top = _lines(spark, sf).groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(20)
    nation = table(spark, sf, "nation")
    taken = _lines(spark, sf).where("l_quantity >= 49").join(table(spark, sf, "supplier"), F.expr("l_suppkey = s_suppkey")).join(F.broadcast(nation), F.expr("s_nationkey = n_nationkey")).select("n_name", "p_brand").distinct()
    units = nation.select("n_name").join(F.broadcast(top))  # 20 rows for each piece of evidence
    return units.join(taken, ["n_name", "p_brand"], "left_anti").select("n_name", "p_brand", "n").orderBy(F.desc("n"), "p_brand", "n_name").limit(300)


@query("distinct_sample", "SELECT DISTINCT p_brand, p_type FROM part ORDER BY p_brand, p_type LIMIT 50")
def distinct_sample(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct().orderBy("p_brand", "p_type").limit(50)


@query("readiness", """SELECT count(*) >= 100 AS enough_rows, count(DISTINCT source) >= 5 AS enough_groups, least(count(*) FILTER (WHERE quality = 0), count(*) FILTER (WHERE quality = 1)) >= 40 AS enough_of_each, count(*) >= 100 AND count(DISTINCT source) >= 5 AND least(count(*) FILTER (WHERE quality = 0), count(*) FILTER (WHERE quality = 1)) >= 40 AS ready FROM labels JOIN documents USING (doc_id)""")
def readiness(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    gates = j.agg((F.count("*") >= 100).alias("enough_rows"), (F.count_distinct("source") >= 5).alias("enough_groups"), (F.least(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)) >= 40).alias("enough_of_each"))
    return gates.withColumn("ready", F.expr("enough_rows AND enough_groups AND enough_of_each"))


@query("flattened_counts", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def flattened_counts(spark, sf):
    """A counter over the members of all lists."""
    return table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
