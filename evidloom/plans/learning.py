"""Vectors, term weights, models and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.operators import evaluation, learning, series
from evidloom.plans.registry import query, table
from evidloom.tables import stored

_STOP = ", ".join(f"'{w}'" for w in learning.STOP)
_TFIDF = f"""c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_]+')) AS term FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM documents)) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
v AS (SELECT term, count(*) AS df, (SELECT count(*) FROM documents) AS n_docs FROM c GROUP BY term HAVING count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY sum(n) DESC, term LIMIT 256),
r AS (SELECT doc_id, term, n * (ln((1 + n_docs) / (1 + df)::DOUBLE) + 1) AS raw FROM c JOIN v USING (term)), w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r)"""
_DEMAND = "d AS (SELECT term, sum(weight) AS weight FROM w JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)"


def _weights(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))
    counts, vocabulary = learning.common_counts(docs, "doc_id", "text", docs.agg(F.count("*").alias("n_docs")))
    return stored(learning.tfidf(counts, "doc_id", vocabulary), "weights")[0], vocabulary  # read by the demand and what is made of it


def _demand(spark, sf, weights):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return stored(weights.join(good, "doc_id", "left_semi").groupBy("term").agg(F.sum("weight").alias("weight")), "demand")[0]


@query("tfidf_weights", f"WITH {_TFIDF} SELECT doc_id, count(*) AS terms, round(max(weight), 6) AS most, round(sum(weight * weight), 6) AS length FROM w GROUP BY 1")
def tfidf_weights(spark, sf):
    w, _ = _weights(spark, sf)
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("most"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("length"))


@query("text_gaps", f"WITH {_TFIDF}, {_DEMAND} SELECT doc_id, round(greatest(0, least(1, 1 - sum(w.weight * coalesce(d.weight, 0)) / (sqrt(sum(w.weight * w.weight)) * (SELECT sqrt(sum(weight * weight)) FROM d)))), 5) AS gap FROM w LEFT JOIN d ON w.term = d.term GROUP BY 1")
def text_gaps(spark, sf):
    """How far each text is from the mean of the wanted ones."""
    w, _ = _weights(spark, sf)
    return learning.gaps(w, "doc_id", _demand(spark, sf, w)).select("doc_id", F.round("gap", 5).alias("gap"))


@query("what_if_gaps", f"""WITH {_TFIDF}, {_DEMAND}, m AS (SELECT doc_id, d.term, d.weight, row_number() OVER (PARTITION BY doc_id ORDER BY d.weight DESC, d.term) AS rn FROM (SELECT DISTINCT doc_id FROM w) k, d WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = k.doc_id AND w.term = d.term)),
x AS (SELECT doc_id, term, weight FROM w UNION ALL SELECT doc_id, term, weight FROM m WHERE rn <= 5)
SELECT doc_id, round(greatest(0, least(1, 1 - sum(x.weight * coalesce(d.weight, 0)) / (sqrt(sum(x.weight * x.weight)) * (SELECT sqrt(sum(weight * weight)) FROM d)))), 5) AS gap FROM x LEFT JOIN d ON x.term = d.term GROUP BY 1""")
def what_if_gaps(spark, sf):
    """The gap left once the five most wanted terms that a text lacks are added."""
    w, _ = _weights(spark, sf)
    demand = _demand(spark, sf, w)
    return learning.gaps(learning.with_missing(w, "doc_id", demand, 5), "doc_id", demand).select("doc_id", F.round("gap", 5).alias("gap"))


@query("scenario", """WITH s AS (SELECT DISTINCT p_brand, skill FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS skill FROM part)), d AS (SELECT skill, count(*) / 1000.0 AS demand FROM (SELECT unnest(string_split(p_name, ' ')) AS skill FROM part WHERE p_size > 10) GROUP BY 1),
a AS (SELECT p_brand, skill FROM s WHERE skill NOT IN ('red') UNION SELECT DISTINCT p_brand, unnest(['welding', 'gear']) FROM s), f AS (SELECT x.p_brand, sum(coalesce(demand, 0.1)::DECIMAL(18, 4))::DOUBLE / count(*) AS before FROM s x LEFT JOIN d USING (skill) GROUP BY 1), g AS (SELECT x.p_brand, sum(coalesce(demand, 0.1)::DECIMAL(18, 4))::DOUBLE / count(*) AS after FROM a x LEFT JOIN d USING (skill) GROUP BY 1)
SELECT f.p_brand, before, after FROM f JOIN g ON f.p_brand = g.p_brand""")
def scenario(spark, sf):
    """Mean demand of each brand's skills before and after some are added and one is dropped."""
    words = lambda d: d.select("p_brand", F.explode(F.split("p_name", " ")).alias("skill"))
    p = table(spark, sf, "part")
    demand = words(p.where("p_size > 10")).groupBy("skill").agg((F.count("*") / 1000).alias("demand"))
    return learning.scenario(words(p).distinct(), "p_brand", ["welding", "gear"], ["red"], demand)


@query("unindexed_vectors", "SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE n_chars > 500) o WHERE o.doc_id = e.vec_id AND o.h = (SELECT md5(text) FROM documents d WHERE d.doc_id = e.vec_id))")
def unindexed_vectors(spark, sf):
    """Rows whose text is not indexed yet, or was indexed otherwise."""
    d = table(spark, sf, "documents")
    have = d.where("n_chars > 500").select(F.col("doc_id").alias("vec_id"), F.md5("text").alias("h"))
    now = table(spark, sf, "embeddings").select("vec_id").join(d.select(F.col("doc_id").alias("vec_id"), F.md5("text").alias("h")), "vec_id", "left")
    return now.join(have, ["vec_id", "h"], "left_anti").select("vec_id")


@query("enriched_rows", """WITH t AS (SELECT p_partkey, p_brand, p_type, string_split(p_name, ' ') AS w FROM part), k AS (SELECT DISTINCT p_type, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size = 7), x AS (SELECT p_partkey, unnest(w) AS w FROM t), m AS (SELECT p_partkey, k.p_type, count(*) AS shared FROM x JOIN k ON x.w = k.w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY shared DESC, p_type) AS rn FROM m) SELECT p_partkey, string_agg(p_type, ',' ORDER BY rn) AS best FROM r WHERE rn <= 3 GROUP BY 1""")
def enriched_rows(spark, sf):
    """The three occupations that share most skills with each row, by a join on skills."""
    p = table(spark, sf, "part")
    words = lambda d, c: d.select(c, F.explode(F.split("p_name", " ")).alias("w"))
    # Rows of the same names are enriched alike: names are matched once, and rows look theirs up.
    named = p.groupBy("p_partkey").agg(F.array_sort(F.collect_list("p_name")).alias("names"))
    each = named.select("names").distinct().select("names", F.explode("names").alias("p_name"))
    m = words(each, "names").join(words(p.where("p_size = 7"), "p_type").distinct(), "w").groupBy("names", "p_type").agg(F.count("*").alias("shared"))
    best = series.top_of(m, ["names"], [F.desc("shared"), "p_type"], 3).groupBy("names").agg(F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("k"), "p_type"))).alias("x"))
    return named.join(best, "names").select("p_partkey", F.array_join(F.transform("x", lambda s: s["p_type"]), ",").alias("best"))


@query("retrieved_context", """WITH q AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), u AS (SELECT label, 'first' AS kind, vec_id AS id, 1.0 / (rn + 1) AS score FROM q WHERE rn <= 8 UNION ALL SELECT label, 'text', doc_id, 1.0 / (2 + rn) FROM (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY n_chars DESC, doc_id) AS rn FROM embeddings JOIN documents ON vec_id = doc_id))
SELECT label, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, kind, id) AS k FROM u) WHERE k <= 6""")
def retrieved_context(spark, sf):
    """The best rows of two kinds of sources together, for each question."""
    e, d = table(spark, sf, "embeddings").select("label", "vec_id"), table(spark, sf, "documents").select("doc_id", "n_chars")
    rank = lambda df, order: df.withColumn("rn", F.row_number().over(series.Window.partitionBy("label").orderBy(*order)))
    first = rank(e, ["vec_id"]).where("rn <= 8").select("label", F.lit("first").alias("kind"), F.col("vec_id").alias("id"), (F.lit(1.0) / (F.col("rn") + 1)).alias("score"))
    text = rank(e.join(d, F.expr("vec_id = doc_id")), [F.desc("n_chars"), "doc_id"]).where("rn <= 8").select("label", F.lit("text").alias("kind"), F.col("doc_id").alias("id"), (F.lit(1.0) / (F.col("rn") + 2)).alias("score"))
    return series.top_of(first.unionByName(text), ["label"], [F.desc("score"), "kind", "id"], 6).select("label", "kind", "id")


@query("standardised", "WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS d FROM part) SELECT p_partkey, round((p_size - m) / d, 5) AS size FROM part, s")
def standardised(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return learning.standardised(p, ["size"]).select("p_partkey", F.round("size", 5).alias("size"))


@query("fold_safe_scaled", "WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders WHERE o_orderdate < DATE '1999-01-01') SELECT o_orderkey, (o_totalprice - a) / (b - a) AS price FROM orders, s")
def fold_safe_scaled(spark, sf):
    """Scaled by what the training rows alone know."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderdate")
    return learning.min_max(o, ["price"], F.col("o_orderdate") < F.lit("1999-01-01").cast("date")).select("o_orderkey", "price")


@query("inflation", """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT feature, round(1 / (1 - r * r), 4) AS vif, 1 / (1 - r * r) < 5 AS kept FROM r, (SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature)""")
def inflation(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    return learning.inflation(rows, ["l_quantity", "l_extendedprice"]).withColumn("vif", F.round("vif", 4))


def _months(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.count("*").alias("n"))


_MONTHS = "m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_orderdate < DATE '2001-08-01' GROUP BY ALL)"


@query("lag_rows", f"WITH {_MONTHS}, r AS (SELECT *, row_number() OVER w AS rn, lag(n, 3) OVER w AS a, lag(n, 2) OVER w AS b, lag(n, 1) OVER w AS c FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)) SELECT o_orderpriority, month::VARCHAR AS month, a || ',' || b || ',' || c AS lags, n AS target FROM r WHERE rn > 3")
def lag_rows(spark, sf):
    m = _months(spark, sf).where("month < DATE'2001-08-01'")
    return learning.lag_rows(m, "o_orderpriority", "month", "n", 3).withColumns({"lags": F.array_join(F.col("lags").cast("array<string>"), ","), "month": F.col("month").cast("string")})


@query("regular_series", f"WITH {_MONTHS} SELECT o_orderpriority, CASE WHEN count(*) <> datediff('month', min(month), max(month)) + 1 THEN 'mixed_or_irregular_periods' WHEN min(n) = max(n) THEN 'constant_or_zero_series' END AS reason FROM m GROUP BY 1")
def regular_series(spark, sf):
    return learning.regular(_months(spark, sf).where("month < DATE'2001-08-01'"), "o_orderpriority", "month", "n")


@query("baseline_choice", f"""WITH {_MONTHS}, r AS (SELECT *, lag(n, 1) OVER w AS a, lag(n, 2) OVER w AS b, lag(n, 3) OVER w AS c, lag(n, 12) OVER w AS s FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)),
e AS (SELECT o_orderpriority, sqrt(sum((n - a) * (n - a))::DOUBLE / count(*)) AS last, sqrt(sum((3 * n - a - b - c) * (3 * n - a - b - c))::DOUBLE / (9 * count(*))) AS mean3, sqrt(sum((n - s) * (n - s))::DOUBLE / count(*)) AS seasonal FROM r WHERE s IS NOT NULL GROUP BY 1)
SELECT o_orderpriority, CASE WHEN last <= seasonal THEN 'last' ELSE 'seasonal' END AS baseline, least(last, seasonal) AS baseline_rmse, (least(last, seasonal) - mean3) / least(last, seasonal) AS improvement FROM e""")
def baseline_choice(spark, sf):
    """The better of two baselines, and what the mean of three gains over it."""
    w = series.Window.partitionBy("o_orderpriority").orderBy("month")
    lag = lambda k: F.lag("n", k).over(w)
    r = _months(spark, sf).where("month < DATE'2001-08-01'").select("o_orderpriority", (F.col("n") - lag(1)).alias("e1"), (3 * F.col("n") - lag(1) - lag(2) - lag(3)).alias("e3"), (F.col("n") - lag(12)).alias("es")).where("es IS NOT NULL")
    rmse = lambda c, k=1: F.sqrt(F.sum(F.col(c) * F.col(c)).cast("double") / (k * F.count("*")))
    wide = r.groupBy("o_orderpriority").agg(rmse("e1").alias("last"), rmse("e3", 9).alias("mean3"), rmse("es").alias("seasonal"))
    return learning.best_baseline(wide.unpivot("o_orderpriority", ["last", "mean3", "seasonal"], "model", "rmse"), "o_orderpriority", "model", "rmse", "mean3")


@query("rolling_forecasts")
def rolling_forecasts(spark, sf):
    """Ridge autoregression and three baselines from rolling origins; tests compare it by brute force."""
    return learning.rolling_origin(_months(spark, sf).where("month < DATE'2001-08-01'"), "o_orderpriority", "month", "n")


@query("bootstrap_interval", """WITH v AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), i AS (SELECT n, row_number() OVER (ORDER BY day, n) - 1 AS i FROM v), k AS (SELECT i AS k FROM i), r AS (SELECT unnest(range(1000)) AS r),
p AS (SELECT r, ('0x' || substr(md5('42:' || r || ':' || k), 1, 8))::BIGINT % (SELECT count(*) FROM v) AS i FROM r, k), m AS (SELECT r, sum(n)::DOUBLE / count(*) AS m FROM p JOIN i ON p.i = i.i GROUP BY 1), o AS (SELECT m, row_number() OVER (ORDER BY m, r) AS rank FROM m)
SELECT max(m) FILTER (WHERE rank = 25) AS low, max(m) FILTER (WHERE rank = 975) AS high FROM o""")
def bootstrap_interval(spark, sf):
    """An interval of the mean number of orders a day, by resampling days."""
    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return learning.bootstrap(days, "n")


@query("alignment_trees")
def alignment_trees(spark, sf):
    """Boosted trees on features of texts, the best threshold on training rows; accuracy is tested, SQL cannot express it."""
    t = F.col("text")
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), F.log1p(F.length(t)).alias("size"), (F.length(F.regexp_replace(t, "[^A-Z]", "")) / (1.0 + F.length(t))).alias("capitals"), (F.length(F.regexp_replace(t, "[^.,;]", "")) / (1.0 + F.length(t))).alias("signs"), (F.length(F.regexp_replace(t, "[^0-9]", "")) / (1.0 + F.length(t))).alias("digits"), (F.size(F.array_distinct(F.split(t, " "))) / F.size(F.split(t, " "))).alias("variety"))
    train = F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0
    scored, _ = learning.boosted(rows, ["size", "capitals", "signs", "digits", "variety"], "label", train)
    best = learning.threshold_sweep(scored.where(train), "label").orderBy(F.desc("f1"), "threshold").limit(1).select("threshold")
    return scored.join(F.broadcast(best)).select("doc_id", train.alias("train"), "label", "score", (F.col("score") * 100 >= F.col("threshold")).alias("aligned"))


@query("alignment_logistic")
def alignment_logistic(spark, sf):
    """Balanced logistic regression on term weights, learnt from four fifths; held-out accuracy is tested, SQL cannot express it."""
    labels = table(spark, sf, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = labels.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return evaluation.text_logistic_scores(rows, F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0, "text", "label").select("doc_id", "label", "score")
