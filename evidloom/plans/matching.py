"""Joins, set operations, text functions and vectors."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from evidloom.functions import numbers, text, vectors
from evidloom.operators import matching
from evidloom.plans.registry import query, table


@query("three_way_join", "SELECT r_name, n_name, count(*) AS suppliers, round(avg(s_acctbal), 4) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def three_way_join(spark, sf):
    j = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.expr("s_nationkey = n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.expr("n_regionkey = r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("balance"))


@query("left_join_counts", "SELECT c_custkey, count(o_orderkey) AS orders, coalesce(max(o_totalprice), 0) AS most FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_counts(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.expr("c_custkey = o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"), F.coalesce(F.max("o_totalprice"), F.lit(0.0)).alias("most"))


@query("without_orders", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def without_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"), F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("with_open_orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
def with_open_orders(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(o, F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey")


@query("fallback_join", """WITH k AS (SELECT s_suppkey, 'Supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') AS name, s_nationkey FROM supplier), n AS (SELECT n_nationkey, any_value(n_name) AS n_name FROM nation GROUP BY 1)
SELECT s_suppkey, coalesce(a.c_mktsegment, b.c_mktsegment) AS c_mktsegment FROM supplier LEFT JOIN (SELECT c_custkey, max(c_mktsegment) AS c_mktsegment FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a ON a.c_custkey = s_suppkey LEFT JOIN (SELECT c_nationkey, max(c_mktsegment) AS c_mktsegment FROM customer GROUP BY 1) b ON b.c_nationkey = s_nationkey""")
def fallback_join(spark, sf):
    c = table(spark, sf, "customer")
    best = c.groupBy("c_nationkey").agg(F.max("c_mktsegment").alias("c_mktsegment"))
    own = c.where("c_acctbal > 5000").select(F.col("c_custkey").cast("long").alias("by_key"), F.lit(None).cast("int").alias("by_nation"), "c_mktsegment")
    both = own.union(best.select(F.lit(None).cast("long"), F.col("c_nationkey"), "c_mktsegment"))
    return matching.fallback_join(table(spark, sf, "supplier"), both, ("s_suppkey", "by_key"), ("s_nationkey", "by_nation"), "c_mktsegment").select("s_suppkey", "c_mktsegment")


@query("parent_levels", "SELECT n.n_nationkey, p.n_nationkey AS parent FROM nation n LEFT JOIN (SELECT n_regionkey, min(n_nationkey) AS n_nationkey FROM nation GROUP BY 1) p ON p.n_regionkey = n.n_regionkey AND p.n_nationkey <> n.n_nationkey")
def parent_levels(spark, sf):
    n = table(spark, sf, "nation")
    p = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("parent"))
    return n.join(F.broadcast(p), "n_regionkey").select("n_nationkey", F.when(F.col("parent") != F.col("n_nationkey"), F.col("parent")).alias("parent"))


@query("alias_matches", """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), a AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:2], ' ') AS alias FROM benchmark),
t AS (SELECT alias, regexp_extract_all(alias, '[a-z0-9]+') AS t FROM a), p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w)
SELECT doc_id, alias, count(*) AS hits, min(i)::INT AS first_at FROM p JOIN t ON w[i + 1] = t[1] AND w[i + 1:i + len(t)] = t GROUP BY 1, 2""")
def alias_matches(spark, sf):
    aliases = table(spark, sf, "benchmark").select(F.array_join(F.slice(text.tokens(F.col("text")), 1, 2), " ").alias("alias")).distinct()
    return matching.alias_matches(table(spark, sf, "documents"), aliases, "text", "alias", ["doc_id"])


@query("containing_range", """WITH r AS (SELECT o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 30 DAY AS e, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
p AS (SELECT o_custkey, l_orderkey, l_linenumber, l_shipdate AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p.o_custkey, p.l_orderkey, p.l_linenumber, p.x AS l_shipdate, r.o_orderkey, coalesce(r.e >= p.x, false) AS inside FROM p ASOF LEFT JOIN r ON p.o_custkey = r.o_custkey AND p.x >= r.s""")
def containing_range(spark, sf):
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey", "o_orderdate").orderBy(F.desc("o_orderkey"))
    r = o.withColumn("rn", F.row_number().over(w)).where("rn = 1").withColumn("until", F.expr("o_orderdate + INTERVAL 30 DAY"))
    p = table(spark, sf, "lineitem").join(o, F.expr("l_orderkey = o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return matching.containing_range(p, r, "o_custkey", "l_shipdate", "o_orderdate", "until", ["o_orderkey"])


@query("duplicate_candidates", """WITH k AS (SELECT DISTINCT p_partkey AS id, unnest(['n:' || p_name, 't:' || p_type || p_brand || p_size]) AS key FROM part), s AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 100)
SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.key = b.key AND a.id < b.id WHERE a.key IN (SELECT key FROM s)""")
def duplicate_candidates(spark, sf):
    p = table(spark, sf, "part")
    return matching.duplicate_candidates(p, "p_partkey", [F.concat(F.lit("n:"), "p_name"), F.concat(F.lit("t:"), "p_type", "p_brand", "p_size")])


@query("overlap_scores", """WITH h AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), w AS (SELECT l_partkey, count(*)::DOUBLE AS weight FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), t AS (SELECT sum(weight) AS t FROM w)
SELECT l_suppkey, count(*) AS items, round(sum(coalesce(weight, 0)) / ((SELECT t FROM t) + count(*) FILTER (WHERE weight IS NULL)), 4) AS alignment, round(sum(coalesce(weight, 0)) / (SELECT t FROM t), 4) AS coverage, round(1 - sum(coalesce(weight, 0)) / (SELECT t FROM t), 4) AS gap FROM h LEFT JOIN w USING (l_partkey) GROUP BY 1""")
def overlap_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    return matching.overlap_scores(li, li.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").cast("double").alias("weight")), "l_suppkey", "l_partkey", "weight")


@query("new_rows", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < DATE '1997-01-01')")
def new_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    return matching.new_rows(o.where("o_orderdate >= DATE '1997-01-01'"), o.where("o_orderdate < DATE '1997-01-01'"), "o_custkey").select("o_custkey")


@query("union_of_sets", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def union_of_sets(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").union(li.where("l_discount > 0.08").select("l_partkey")).distinct()


@query("three_way_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.05 INTERSECT SELECT p_partkey FROM part WHERE p_size > 10 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def three_way_intersection(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_discount > 0.05").select("l_partkey")).intersect(table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))).subtract(li.where("l_quantity > 49").select("l_partkey"))


@query("set_differences", """WITH s AS (SELECT l_suppkey, list(DISTINCT l_returnflag) AS r FROM lineitem GROUP BY 1) SELECT l_suppkey, array_to_string(list_sort(list_intersect(r, ['A', 'N'])), ',') AS shared, array_to_string(list_sort(list_filter(['A', 'N', 'X'], lambda x: NOT list_contains(r, x))), ',') AS missing FROM s""")
def set_differences(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("r"))
    have = lambda *x: F.array(*[F.lit(v) for v in x])
    return s.select("l_suppkey", F.array_join(F.array_sort(F.array_intersect("r", have("A", "N"))), ",").alias("shared"), F.array_join(F.array_sort(F.array_except(have("A", "N", "X"), F.col("r"))), ",").alias("missing"))


@query("clean_text", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.clean_text(F.col("text")), 256).alias("digest"))


@query("slugs", "SELECT p_partkey, CASE WHEN s = '' THEN 'skill' ELSE s END AS key FROM (SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 150) AS s FROM part)")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" & "), "p_type")).alias("key"))


@query("duplicate_keys", "SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(p_name || ' and the skills'), '[&/\\-]', ' ', 'g'), '[a-z0-9+#.]+'), lambda w: w NOT IN ('skills', 'skill', 'the', 'and')), ' ') AS key FROM part")
def duplicate_keys(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.duplicate_key(F.concat("p_name", F.lit(" and the skills"))).alias("key"))


@query("fingerprints", r"SELECT c_custkey, sha256(lower(trim(regexp_replace(c_name, '\s+', ' ', 'g'))) || '|' || lower(c_mktsegment) || '|' || c_nationkey) AS fingerprint FROM customer")
def fingerprints(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.fingerprint(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("fingerprint"))


@query("text_chunks", "SELECT doc_id, i::INT AS number, (i * 1600)::INT AS start, length(substr(text, i * 1600 + 1, 1800)) AS size FROM (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 200) / 1600.0), 1)::BIGINT)) AS i FROM documents)")
def text_chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c")).select("doc_id", "c.number", "c.start", F.length("c.piece").cast("long").alias("size"))


@query("keyword_evidence", "SELECT doc_id, strpos(lower(text), 'license')::INT AS at, substr(text, greatest(strpos(lower(text), 'license') - 120, 1)::INT, (strpos(lower(text), 'license') + 7 + 120 - greatest(strpos(lower(text), 'license') - 120, 1))::INT) AS evidence FROM documents WHERE strpos(lower(text), 'license') > 0")
def keyword_evidence(spark, sf):
    d = table(spark, sf, "documents").withColumn("at", F.instr(F.lower("text"), "license")).where("at > 0")
    return d.select("doc_id", "at", text.evidence_window(F.col("text"), F.col("at"), F.lit(7)).alias("evidence"))


@query("rule_classes", "SELECT CASE WHEN regexp_matches(text, '(password|token|secret)\\s*=') THEN 'secret' WHEN regexp_matches(text, '[Ll]icen[cs]e') THEN 'license' WHEN regexp_matches(text, '\\|') THEN 'table' WHEN regexp_matches(text, '!!') THEN 'shout' ELSE 'prose' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def rule_classes(spark, sf):
    rules = [("secret", r"(password|token|secret)\s*="), ("license", "[Ll]icen[cs]e"), ("table", r"\|"), ("shout", "!!")]
    return table(spark, sf, "documents").groupBy(text.first_match(F.col("text"), rules, "prose").alias("kind")).agg(F.count("*").alias("n"))


@query("token_jaccard", """WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), w AS (SELECT item_id, unnest(t) AS x FROM t), n AS (SELECT item_id, len(t) AS n FROM t)
SELECT a.item_id AS a, b.item_id AS b, round(count(*)::DOUBLE / (x.n + y.n - count(*)), 4) AS jaccard FROM w a JOIN w b ON a.x = b.x AND a.item_id < b.item_id JOIN n x ON x.item_id = a.item_id JOIN n y ON y.item_id = b.item_id GROUP BY a.item_id, b.item_id, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= 0.1""")
def token_jaccard(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    return matching.jaccard_pairs(t, "item_id", "t", 0.1).select("a", "b", F.round("jaccard", 4).alias("jaccard"))


@query("vector_norms", "SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings GROUP BY 1")
def vector_norms(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vectors.norm(F.col("embedding"))), 6).alias("mean_norm"))


@query("text_statistics", r"SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\S+')) AS words, round(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::DOUBLE / greatest(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 1), 4) AS diversity FROM documents")
def text_statistics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", text.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("text").cast("long").alias("chars"), F.regexp_count("text", F.lit(r"[^\s]+")).cast("long").alias("words"), F.round(numbers.ratio(F.size(F.array_distinct("t")), F.greatest(F.size("t"), F.lit(1))), 4).alias("diversity"))
