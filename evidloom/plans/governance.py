"""Quality of sources, reviews, changes of tables, sets and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions.numbers import exact_mean
from evidloom.operators import evidence, governance, series, variants
from evidloom.plans.registry import query, table


@query("completeness", """WITH c AS (SELECT source, count(*) FILTER (WHERE trim(text) <> '')::DOUBLE / count(*) AS with_text, count(*) FILTER (WHERE lang IN ('en', 'de'))::DOUBLE / count(*) AS with_lang, count(*) FILTER (WHERE n_chars >= 400)::DOUBLE / count(*) AS with_size, count(*) AS n FROM documents GROUP BY 1)
SELECT *, (with_text + with_lang + with_size) / 3 AS quality FROM c""")
def completeness(spark, sf):
    """Shares of rows that have each part, and their mean."""
    d = table(spark, sf, "documents")
    return governance.completeness(d, "source", {"with_text": F.trim("text") != "", "with_lang": F.col("lang").isin("en", "de"), "with_size": F.col("n_chars") >= 400})


@query("contract_drift", """WITH f AS (SELECT event_type, ['k', 'channel'] AS expected, json_keys(props) AS observed FROM events),
d AS (SELECT event_type, len(list_filter(expected, lambda x: NOT list_contains(observed, x))) AS missing, len(list_filter(observed, lambda x: NOT list_contains(expected, x))) AS unexpected FROM f),
s AS (SELECT event_type, count(*) AS n, sum(missing)::BIGINT AS missing, sum(unexpected)::BIGINT AS unexpected, (sum(missing) + sum(unexpected))::DOUBLE / (count(*) * 2) AS score FROM d GROUP BY 1)
SELECT *, CASE WHEN score < 0.05 THEN 'stable' WHEN score < 0.2 THEN 'watch' ELSE 'changed' END AS status FROM s""")
def contract_drift(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.json_object_keys("props").alias("observed"))
    return governance.drift(e, "event_type", "observed", ["k", "channel"])


@query("field_differences", """WITH p AS (SELECT DISTINCT event_type, unnest(json_keys(props)) AS k FROM events), o AS (SELECT event_type, list(k) AS fields FROM p GROUP BY 1)
SELECT event_type, array_to_string(list_sort(list_filter(['channel', 'k'], lambda x: NOT list_contains(fields, x))), ',') AS missing, array_to_string(list_sort(list_filter(fields, lambda x: NOT list_contains(['channel', 'k'], x))), ',') AS unexpected FROM o""")
def field_differences(spark, sf):
    fields = table(spark, sf, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("k")).groupBy("event_type").agg(F.collect_set("k").alias("fields"))
    expected = F.array(F.lit("channel"), F.lit("k"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return fields.select("event_type", text(F.array_except(expected, "fields")).alias("missing"), text(F.array_except("fields", expected)).alias("unexpected"))


@query("version_counts", """WITH a AS (SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE year(o_orderdate) = 1995 AND o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS key, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 AND o_totalprice > 499000 GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, coalesce(a.n, 0) AS old, coalesce(b.n, 0) AS new, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.key = b.key""")
def version_counts(spark, sf):
    o = table(spark, sf, "orders")
    return governance.compared(o.where("year(o_orderdate) = 1995 AND o_orderstatus = 'F'"), o.where("year(o_orderdate) = 1996 AND o_totalprice > 499000"), "o_orderpriority")


@query("id_changes", """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate < DATE '1998-01-01'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate >= DATE '1998-01-01')
SELECT id, 'removed' AS change FROM a ANTI JOIN b USING (id) UNION ALL SELECT id, 'added' FROM b ANTI JOIN a USING (id)""")
def id_changes(spark, sf):
    """Ids that were there before and are not now, and the other way round."""
    o = table(spark, sf, "orders")
    a, b = (o.where(f"o_orderdate {op} DATE'1998-01-01'").select(F.col("o_custkey").alias("id")).distinct() for op in ("<", ">="))
    return governance.changes(a, b, "id")


@query("split_union", "SELECT 'development' AS split, o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate < DATE '2000-01-01' GROUP BY ALL UNION ALL SELECT 'holdout', o_orderpriority, count(*) FROM orders WHERE o_orderdate >= DATE '2000-01-01' GROUP BY ALL")
def split_union(spark, sf):
    o = table(spark, sf, "orders")
    parts = o.where("o_orderdate < DATE'2000-01-01'").withColumn("split", F.lit("development")).unionByName(o.where("o_orderdate >= DATE'2000-01-01'").withColumn("split", F.lit("holdout")))
    return parts.groupBy("split", "o_orderpriority").agg(F.count("*").alias("n"))


@query("changed_rows", """WITH old AS (SELECT o_custkey AS id, sha256(max(o_orderkey)::VARCHAR) AS hash FROM orders WHERE o_orderdate < DATE '2000-01-01' GROUP BY 1), new AS (SELECT o_custkey AS id, sha256(max(o_orderkey)::VARCHAR) AS hash FROM orders GROUP BY 1)
SELECT new.id, CASE WHEN old.id IS NULL THEN 'insert' ELSE 'update' END AS action FROM new LEFT JOIN old ON new.id = old.id WHERE old.hash IS DISTINCT FROM new.hash""")
def changed_rows(spark, sf):
    """Rows to be written: new ones and those of another content hash; equal ones are skipped."""
    o = table(spark, sf, "orders")
    state = lambda d: d.groupBy(F.col("o_custkey").alias("id")).agg(F.sha2(F.max("o_orderkey").cast("string"), 256).alias("hash"))
    return governance.to_write(state(o.where("o_orderdate < DATE'2000-01-01'")), state(o), "id", "hash")


@query("auto_approved", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, row_number() OVER (ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem WHERE l_discount >= 0.1 AND l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, l_partkey, 'approved' AS status FROM r WHERE rn <= 500""")
def auto_approved(spark, sf):
    """At most 500 pending rows of enough confidence become approved, the surest first."""
    pending = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_discount >= 0.1")
    return pending.orderBy(F.desc("l_discount"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").limit(500).select("l_orderkey", "l_linenumber", "l_partkey", F.lit("approved").alias("status"))


@query("merged_entities", """WITH m AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS target FROM part)
SELECT coalesce(m.target, l_partkey) AS partkey, count(*) AS lines, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem LEFT JOIN m ON l_partkey = m.id GROUP BY 1""")
def merged_entities(spark, sf):
    """Facts of entities that are one, pointed to the least of them."""
    p = table(spark, sf, "part")
    target = p.groupBy("p_name", "p_brand", "p_type").agg(F.min("p_partkey").alias("target"))
    remap = p.join(target, ["p_name", "p_brand", "p_type"]).where("target <> p_partkey").select(F.col("p_partkey").alias("id"), "target")
    lines = governance.repointed(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("partkey"), "l_quantity"), remap, "partkey")
    return lines.groupBy("partkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("adjudicated", """WITH v AS (SELECT DISTINCT o_custkey AS task, o_orderstatus AS label, o_orderpriority AS reviewer, o_orderdate AS t, o_orderkey AS k FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY task, reviewer ORDER BY t, k) AS own FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY t, k) AS rn FROM f WHERE own = 1), p AS (SELECT task, max(label) FILTER (WHERE rn = 1) AS first_label, max(label) FILTER (WHERE rn = 2) AS second_label, max(label) FILTER (WHERE rn = 3) AS third FROM r GROUP BY 1)
SELECT task, first_label, second_label, CASE WHEN second_label IS NULL THEN 'first_done' WHEN first_label = second_label THEN 'complete' WHEN third IS NULL THEN 'needs_adjudication' ELSE 'adjudicated' END AS state, CASE WHEN first_label = second_label THEN first_label WHEN second_label IS NOT NULL THEN third END AS final FROM p""")
def adjudicated(spark, sf):
    """Labels by two reviewers; where they differ, by a third; a reviewer counts once a task."""
    votes = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("reviewer"), F.col("o_orderstatus").alias("label"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return governance.adjudicated(votes)


@query("review_tasks", """WITH g AS (SELECT p_brand, l_partkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, l_partkey) AS rn FROM g),
t AS (SELECT 'skill' AS level, p_brand AS unit FROM g UNION SELECT 'skill_part', p_brand || '|' || l_partkey FROM r WHERE rn <= 20)
SELECT level, unit, sha256(level || '|' || unit) AS task_key FROM t""")
def review_tasks(spark, sf):
    """Tasks for each skill and its 20 greatest signals, named by a hash so that a rerun adds none."""
    g = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey")).groupBy("p_brand", "l_partkey").agg(F.count("*").alias("n"))
    fine = series.top_of(g, ["p_brand"], [F.desc("n"), "l_partkey"], 20)
    t = g.select(F.lit("skill").alias("level"), F.col("p_brand").alias("unit")).distinct().unionByName(fine.select(F.lit("skill_part").alias("level"), F.concat_ws("|", "p_brand", "l_partkey").alias("unit")))
    return t.withColumn("task_key", F.sha2(F.concat_ws("|", "level", "unit"), 256))


@query("review_queue", """SELECT p.p_partkey, length(p.p_name) AS size, count(l_orderkey) AS uses FROM part p LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity >= 45 WHERE p_name LIKE 'small%' OR p_size < 3 GROUP BY ALL ORDER BY uses DESC, p_partkey LIMIT 100""")
def review_queue(spark, sf):
    """Doubtful entities with the number of their uses, the most used first."""
    doubtful = table(spark, sf, "part").where("p_name LIKE 'small%' OR p_size < 3").select("p_partkey", F.length("p_name").cast("long").alias("size"))
    uses = table(spark, sf, "lineitem").where("l_quantity >= 45").groupBy("l_partkey").agg(F.count("*").alias("uses"))
    return evidence.context(doubtful, "p_partkey", [(uses, "l_partkey")]).fillna(0, ["uses"]).orderBy(F.desc("uses"), "p_partkey").limit(100)


@query("provenance", """WITH e AS (SELECT o_orderkey AS id, 0 AS step, 'received' AS stage, o_orderdate AS day FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT l_orderkey, 1, 'shipped', min(l_shipdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT l_orderkey, 2, 'returned', max(l_shipdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_returnflag = 'R' GROUP BY 1)
SELECT id, count(*) AS stages, string_agg(stage || '@' || strftime(day, '%Y-%m-%d'), ' > ' ORDER BY step) AS dossier FROM e GROUP BY 1""")
def provenance(spark, sf):
    """The stages that each record passed, in order, from the tables that tell of them."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_shipdate", "l_returnflag").join(o.select("id"), "id", "left_semi")
    shipped = lines.groupBy("id").agg(F.min("l_shipdate").alias("shipped"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("returned"))
    return governance.dossier(o.withColumnRenamed("o_orderdate", "received").join(shipped, "id", "left"), "id", ["received", "shipped", "returned"])


@query("row_summary", """SELECT p_brand, count(*) AS rows, count(*) * 2 AS numeric_cells, count(p_size) + count(p_retailprice) AS filled, sum(p_size)::BIGINT AS total FROM part GROUP BY 1""")
def row_summary(spark, sf):
    """Cells that are numbers in the rows of a table given as maps, and their sum."""
    rows = table(spark, sf, "part").select("p_brand", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("name"), F.col("p_name")).alias("row"))
    numeric, _ = governance.numeric_and_text(F.col("row"))
    rows = rows.withColumn("numbers", numeric)
    return rows.groupBy("p_brand").agg(F.count("*").alias("rows"), F.sum(F.size("numbers")).alias("numeric_cells"), F.sum(F.size(F.filter(F.map_values("numbers"), lambda x: x.isNotNull()))).alias("filled"), F.sum(F.col("numbers")["size"].cast("long")).alias("total"))


@query("split_rows", """SELECT p_partkey, 'name=' || p_name || ',type=' || p_type AS descriptors, p_size::DOUBLE AS size, p_retailprice AS price FROM part""")
def split_rows(spark, sf):
    """A row's cells as a map of numbers and a map of descriptors."""
    row = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"))
    rows = table(spark, sf, "part").withColumn("row", row)
    numeric, text = governance.numeric_and_text(F.col("row"))
    rows = rows.select("p_partkey", numeric.alias("n"), text.alias("t"))
    return rows.select("p_partkey", F.array_join(F.transform(F.array_sort(F.map_entries("t")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("descriptors"), F.col("n")["size"].alias("size"), F.col("n")["price"].alias("price"))


@query("patched_json", """SELECT event_id, json_extract_string(json_merge_patch(props, '{"channel": "web", "seen": true}'), '$.channel') AS channel, json_extract_string(props, '$.k') AS k FROM events""")
def patched_json(spark, sf):
    """JSON objects with the members of another put over their own."""
    m = governance.merged_maps(F.from_json("props", "map<string,string>"), F.create_map(F.lit("channel"), F.lit("web"), F.lit("seen"), F.lit("true")))
    return table(spark, sf, "events").select("event_id", m["channel"].alias("channel"), m["k"].alias("k"))


@query("json_leaves", """SELECT path, count(*) AS n, max(v::INT) AS most FROM (SELECT 'k' AS path, json_extract_string(props, '$.k') AS v FROM events) GROUP BY 1""")
def json_leaves(spark, sf):
    """(path, value) of each leaf of a JSON object, whatever its depth."""
    e = table(spark, sf, "events").select("event_id", F.col("props").alias("json"))
    return variants.leaves(e, "json", keep=[]).groupBy("path").agg(F.count("*").alias("n"), F.max(F.col("value").cast("int")).alias("most"))


def _nested_orders(spark, sf):
    """Each order as JSON, with its customer and lines."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("lines"))
    o = table(spark, sf, "orders").join(li, F.expr("o_orderkey = l_orderkey"), "left")
    whole = F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("priority")).alias("customer"), "lines")
    return o.select("o_orderkey", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


@query("order_leaves", """WITH l AS (SELECT 'key' AS path, o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT 'customer.key', o_custkey::VARCHAR FROM orders UNION ALL SELECT 'customer.priority', o_orderpriority FROM orders
UNION ALL SELECT 'lines', NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'lines[].l_linenumber', l_linenumber::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'lines[].l_quantity', l_quantity::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'lines[].l_returnflag', l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT path, count(*) AS n, count(v) AS given, sum(TRY_CAST(v AS DOUBLE)) AS total, count(DISTINCT CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END) AS texts FROM l GROUP BY 1""")
def order_leaves(spark, sf):
    """The leaves of nested orders by path, whatever the place in the list of lines."""
    found = variants.leaves(_nested_orders(spark, sf), "json", keep=[]).select(F.regexp_replace("path", r"\[\d+\]", "[]").alias("path"), "value", F.expr("try_cast(value AS double)").alias("x"))
    return found.groupBy("path").agg(F.count("*").alias("n"), F.count("value").alias("given"), F.sum("x").alias("total"), F.count_distinct(F.when(F.col("x").isNull(), F.col("value"))).alias("texts"))


@query("cleaned_json", r"""SELECT conv_id, md5(to_json({'conv_id': conv_id, 'turns': list({'role': role, 'text': trim(regexp_replace(text, '\s+', ' ', 'g')), 'turn': turn} ORDER BY turn)})::VARCHAR) AS digest FROM conversations GROUP BY conv_id""")
def cleaned_json(spark, sf):
    """Whole conversations as JSON, with the spaces of every text in them collapsed."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(turns).select("conv_id", F.to_json(F.struct("conv_id", "turns"), {"ignoreNullFields": "false"}).alias("json"))
    return variants.cleaned_json(c, "json", "clean").select("conv_id", F.md5("clean").alias("digest"))


@query("canonical_json", """SELECT event_id, sha256('{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}') AS hash FROM events""")
def canonical_json(spark, sf):
    """A hash of a record in canonical JSON: keys sorted, no spaces."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.sha2(F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type"))), 256).alias("hash"))


@query("crosswalk", """WITH d AS (SELECT DISTINCT p_type, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50), n AS (SELECT count(DISTINCT l_suppkey) AS all_ FROM lineitem), c AS (SELECT p_type, count(*) AS suppliers FROM d GROUP BY 1)
SELECT p_type, suppliers, 100.0::DOUBLE * suppliers / all_ AS coverage FROM c, n ORDER BY suppliers DESC, p_type LIMIT 20""")
def crosswalk(spark, sf):
    """How many modules each skill reaches, of all, for the 20 that reach most."""
    lines = table(spark, sf, "lineitem")
    d = lines.where("l_quantity = 50").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey")).select("p_type", "l_suppkey").distinct()
    return governance.coverage(d, lines.select("l_suppkey"), "p_type", "l_suppkey", 20).withColumnRenamed("reached", "suppliers")


@query("safe_boundary", """WITH g AS (SELECT date_trunc('month', o_orderdate)::DATE AS grp, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT grp, sum(n) OVER (ORDER BY grp)::BIGINT AS before, sum(n) OVER ()::BIGINT AS total FROM g)
SELECT before AS boundary, total, before::DOUBLE / total AS share FROM c WHERE before < total ORDER BY abs(before - total * 0.8), before LIMIT 1""")
def safe_boundary(spark, sf):
    """Where to split rows in order near 80 % so that no month is on both sides."""
    o = table(spark, sf, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("grp"), "o_orderdate")
    return series.safe_boundary(o, "grp", "o_orderdate", 0.8)


@query("stratified_take", """WITH s AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) AS k, count(*) OVER () AS strata FROM documents GROUP BY 1), a AS (SELECT lang, (90 // strata) + CASE WHEN k <= 90 % strata THEN 1 ELSE 0 END AS take FROM s),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) AS rn FROM documents) SELECT doc_id, r.lang FROM r JOIN a ON r.lang = a.lang WHERE rn <= take""")
def stratified_take(spark, sf):
    """Ninety rows, dealt evenly over the languages, by a seeded hash."""
    return series.stratified(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 90, seed=7)


@query("clamped_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def clamped_page(spark, sf):
    """A page whose asked size of 5,000 is held to 100."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(evidence.clamped(5000, 100))


@query("promotion", """WITH m AS (SELECT l_suppkey AS model, sum(l_discount::DECIMAL(18, 4))::DOUBLE / count(l_discount) AS score, count(*) AS n, max(l_tax) - min(l_tax) AS spread FROM lineitem GROUP BY 1), b AS (SELECT sum(l_discount::DECIMAL(18, 4))::DOUBLE / count(l_discount) AS base FROM lineitem),
g AS (SELECT model, score, score > base AS beats_baseline, spread <= 0.08 AS stable, n >= 100 AS enough FROM m, b) SELECT *, beats_baseline AND stable AND enough AND row_number() OVER (PARTITION BY beats_baseline AND stable AND enough ORDER BY score DESC, model) = 1 AS active FROM g""")
def promotion(spark, sf):
    """Gates of promotion for each model; the best of those that pass all is active."""
    lines = table(spark, sf, "lineitem")
    m = lines.groupBy(F.col("l_suppkey").alias("model")).agg(exact_mean("l_discount").alias("score"), F.count("*").alias("n"), (F.max("l_tax") - F.min("l_tax")).alias("spread"))
    g = m.join(F.broadcast(lines.agg(exact_mean("l_discount").alias("base")))).select("model", "score", (F.col("score") > F.col("base")).alias("beats_baseline"), (F.col("spread") <= 0.08).alias("stable"), (F.col("n") >= 100).alias("enough"))
    passed = F.expr("beats_baseline AND stable AND enough")
    best = g.where(passed).orderBy(F.desc("score"), "model").limit(1).select(F.col("model").alias("best"))
    return g.join(F.broadcast(best), F.col("model") == F.col("best"), "left").withColumn("active", F.col("best").isNotNull()).drop("best")


@query("latency_ring", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT event_type, count(*) AS kept, max(value) AS most, min(value) AS least FROM r WHERE rn <= 500 GROUP BY 1""")
def latency_ring(spark, sf):
    """The last 500 measurements of each kind."""
    last = series.top_of(table(spark, sf, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 500)
    return last.groupBy("event_type").agg(F.count("*").alias("kept"), F.max("value").alias("most"), F.min("value").alias("least"))


@query("sidecar_enriched", """SELECT o_orderkey, o_orderstatus, coalesce(a.note, b.note, 'none') AS note FROM orders LEFT JOIN (SELECT p_partkey AS k, p_name AS note FROM part WHERE p_size > 40) a ON o_orderkey = a.k LEFT JOIN (SELECT sha256('o' || p_partkey) AS h, p_type AS note FROM part WHERE p_size <= 10) b ON sha256('o' || o_orderkey) = b.h""")
def sidecar_enriched(spark, sf):
    """Records filled from a sidecar by link, or else by the hash of the link: two equi-joins, no OR."""
    p = table(spark, sf, "part")
    hashed = lambda c: F.sha2(F.concat(F.lit("o"), F.col(c).cast("string")), 256)
    by_link = p.where("p_size > 40").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("by_link"))
    by_hash = p.where("p_size <= 10").select(hashed("p_partkey").alias("h"), F.col("p_type").alias("by_hash"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", hashed("o_orderkey").alias("h"))
    return o.join(by_link, F.expr("o_orderkey = k"), "left").join(by_hash, "h", "left").select("o_orderkey", "o_orderstatus", F.coalesce("by_link", "by_hash", F.lit("none")).alias("note"))


@query("code_parents", """WITH c AS (SELECT DISTINCT p_brand AS code FROM part) SELECT a.code, max_by(b.code, length(b.code)) AS parent FROM c a LEFT JOIN c b ON starts_with(a.code, b.code) AND a.code <> b.code GROUP BY 1""")
def code_parents(spark, sf):
    """The longest other code with which each code begins, by joins on its prefixes."""
    return governance.longest_prefix(table(spark, sf, "part").select(F.col("p_brand").alias("code")).distinct(), "code")


@query("taxonomy_import", """WITH old AS (SELECT p_name AS uri, min(p_partkey) AS id FROM part WHERE p_size <= 10 GROUP BY 1), rows AS (SELECT p_name AS uri, max(p_partkey) AS id FROM part WHERE p_name LIKE '%e%' AND p_size < 30 GROUP BY 1)
SELECT coalesce(r.uri, o.uri) AS uri, coalesce(r.id, o.id) AS id, CASE WHEN r.uri IS NULL THEN 'kept' WHEN o.uri IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM old o FULL JOIN rows r ON o.uri = r.uri""")
def taxonomy_import(spark, sf):
    """An idempotent upsert by URI, with what became of each row."""
    p = table(spark, sf, "part")
    old = p.where("p_size <= 10").groupBy(F.col("p_name").alias("uri")).agg(F.min("p_partkey").alias("id"))
    rows = p.where("p_name LIKE '%e%' AND p_size < 30").groupBy(F.col("p_name").alias("uri")).agg(F.max("p_partkey").alias("id"))
    return governance.imported(old, rows, "uri")


@query("raw_lane", """SELECT event_id, sha256('{"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '"}') AS content_hash FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')""")
def raw_lane(spark, sf):
    """Rows of no known kind, whole, as JSON with a content hash."""
    e = table(spark, sf, "events").where(~F.col("event_type").isin("view", "click", "purchase"))
    return e.select("event_id", F.sha2(F.to_json(F.struct("event_type", "props")), 256).alias("content_hash"))


@query("tenant_rows", "SELECT doc_id, source FROM documents WHERE source = 'src1' OR nullif(source, 'src2') IS NULL")
def tenant_rows(spark, sf):
    """Rows of a tenant and those that are shared (without one)."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.nullif(F.col("source"), F.lit("src2")).alias("tenant"))
    return governance.for_tenant(d, "tenant", "src1").select("doc_id", "source")


