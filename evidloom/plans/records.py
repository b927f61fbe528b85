"""Records and texts: projections, predicates, extraction, scores of single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions import extract, text
from evidloom.functions.numbers import clip
from evidloom.operators import duplicates, evidence, series
from evidloom.plans.registry import query, table


@query("canonical_records", """SELECT 'ev-' || event_id AS record_id, coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k')) AS code, coalesce(nullif(event_type, ''), 'unknown') AS title, user_id::VARCHAR AS owner, sha256(event_type || '|' || user_id) AS fingerprint FROM events""")
def canonical_records(spark, sf):
    """Payloads of a provider as canonical records: the first of several names that is filled, and an id with the provider's prefix."""
    e = table(spark, sf, "events")
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("label")).alias("category"), F.col("user_id").alias("owner"), F.from_json("props", "map<string,string>").alias("extra")))
    fields = {"id": ["job_id", "id"], "code": ["extra.key", "extra.k"], "title": ["title", "category.label"], "owner": ["owner", "user"]}
    got = extract.canonical(e.select(payload.alias("payload")), "payload", fields, prefix="ev-")
    return got.select(F.col("id").alias("record_id"), "code", F.coalesce("title", F.lit("unknown")).alias("title"), "owner", text.fingerprint(F.col("title"), F.col("owner")).alias("fingerprint"))


@query("cleaned_records", "SELECT c_custkey, lower(c_name) AS name, coalesce(nullif(c_mktsegment, ''), 'none') AS segment, n_name AS country, r_name AS region, sha256(lower(c_name) || '|' || lower(n_name)) AS fingerprint FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def cleaned_records(spark, sf):
    """The canonical projection of a record, with its place as a struct and a fingerprint."""
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", F.struct(F.col("n_name").alias("country"), F.col("r_name").alias("region")).alias("place"))
    c = table(spark, sf, "customer").join(F.broadcast(place), F.expr("c_nationkey = n_nationkey"))
    return c.select("c_custkey", text.normalise(F.col("c_name")).alias("name"), extract.first_filled("c_mktsegment", default="none").alias("segment"), "place.country", "place.region", text.fingerprint(F.col("c_name"), F.col("place.country")).alias("fingerprint"))


@query("escaped_search", "SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%#00000\\_%' ESCAPE '\\' OR s_name ILIKE '%R#00000000%' ESCAPE '\\'")
def escaped_search(spark, sf):
    """What users type, of which wildcards are but signs."""
    name = F.col("s_name")
    return table(spark, sf, "supplier").where(evidence.escaped_like(name, "#00000_") | evidence.escaped_like(name, "r#00000000")).select("s_suppkey")


@query("region_like", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name ILIKE '%N_1%' OR n_name ILIKE '%tion_20'")
def region_like(spark, sf):
    near = table(spark, sf, "nation").where(evidence.any_like(F.col("n_name"), ["%N_1%", "%tion_20"]))
    return table(spark, sf, "customer").join(F.broadcast(near), F.expr("c_nationkey = n_nationkey"), "left_semi").select("c_custkey")


@query("noise_reasons", """WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents), t AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^ ]+')) AS words, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters FROM f)
SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN length(line) < 4 THEN 'too_short' END, CASE WHEN words > 10 THEN 'too_many_words' END, CASE WHEN letters * 2 < length(line) THEN 'few_letters' END, CASE WHEN lower(trim(line)) IN ('the', 'and', 'other') THEN 'generic' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM t""")
def noise_reasons(spark, sf):
    """Why a document's first line is no proper name."""
    d = table(spark, sf, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    return d.select("doc_id", F.array_join(extract.noise_reasons(F.col("line"), generic=("the", "and", "other")), ",").alias("reasons"))


@query("relevant_rows", """SELECT p_partkey, p_type IN ('PROMO') AS by_category, regexp_matches(lower(p_name), '(^|[^a-z0-9])(red|old)($|[^a-z0-9])') OR contains(lower(p_name), 'small ring') AS by_term FROM part WHERE p_type IN ('PROMO') OR regexp_matches(lower(p_name), '(^|[^a-z0-9])(red|old)($|[^a-z0-9])') OR contains(lower(p_name), 'small ring')""")
def relevant_rows(spark, sf):
    """Rows of an allowed category, or with a term: single words at word ends, terms of several words anywhere."""
    by_category, by_term = F.col("p_type").isin("PROMO"), extract.has_term(F.col("p_name"), ["red", "old", "small ring"])
    return table(spark, sf, "part").where(by_category | by_term).select("p_partkey", by_category.alias("by_category"), by_term.alias("by_term"))


@query("generic_terms", "SELECT p_partkey FROM part WHERE lower(trim(p_name)) IN ('red bolt', 'old gear') OR lower(trim(p_type)) IN ('economy')")
def generic_terms(spark, sf):
    return table(spark, sf, "part").where(text.normalise(F.col("p_name")).isin("red bolt", "old gear") | text.normalise(F.col("p_type")).isin("economy")).select("p_partkey")


@query("actionable_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity >= 10 AND l_discount > 0.05 AND NOT (l_linestatus = 'F' AND l_tax > 0.06)")
def actionable_rows(spark, sf):
    return table(spark, sf, "lineitem").where("l_returnflag <> 'N' AND l_quantity >= 10 AND l_discount > 0.05 AND NOT (l_linestatus = 'F' AND l_tax > 0.06)").select("l_orderkey", "l_linenumber", "l_partkey")


@query("empirical_rows", "SELECT event_id FROM events WHERE (json_extract_string(props, '$.use') IS NULL OR json_extract_string(props, '$.use') <> 'false') AND value > 0 AND json_extract_string(props, '$.k')::INT > 10")
def empirical_rows(spark, sf):
    """Rows that a flag within JSON does not exclude, with evidence and confidence."""
    flag, k = F.get_json_object("props", "$.use"), F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").where((flag.isNull() | (flag != "false")) & (F.col("value") > 0) & (k > 10)).select("event_id")


@query("date_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def date_range(spark, sf):
    """Days, both included; times that cannot be parsed are left out."""
    return table(spark, sf, "events").where(extract.within_days(F.col("ts").cast("string"), "2024-01-05", "2024-01-10")).select("event_id")


@query("row_roles", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents)
SELECT doc_id, CASE WHEN trim(line) = '' THEN 'noise' WHEN regexp_matches(line, '^(Note|Source|Re)[ .,:]') THEN 'note' WHEN regexp_matches(line, '^[*\[(]') THEN 'footnote' WHEN regexp_matches(lower(line), '^(total|all) ') THEN 'total' WHEN regexp_matches(line, '[0-9]') THEN 'fact' ELSE 'header' END AS role FROM l""")
def row_roles(spark, sf):
    """What a line of a table is: the first rule that fits."""
    line = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", extract.row_role(line).alias("role"))


@query("keyword_skills", """WITH k AS (SELECT * FROM (VALUES ('metal', 'bolt'), ('metal', 'gear'), ('colour', 'red'), ('colour', 'blue'), ('size', 'small'), ('jewel', 'ring')) t(skill, word))
SELECT p_partkey, coalesce(string_agg(DISTINCT skill, ',' ORDER BY skill), '') AS skills FROM part LEFT JOIN k ON contains(p_name, word) GROUP BY 1""")
def keyword_skills(spark, sf):
    """Skills of which a keyword is anywhere in the cleaned text, sorted."""
    found = extract.keyword_skills(F.col("p_name"), {"metal": ["bolt", "gear"], "colour": ["red", "blue"], "size": ["small"], "jewel": ["ring"]})
    return table(spark, sf, "part").select("p_partkey", F.array_join(found, ",").alias("skills"))


@query("curated_phrases", """WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS skill, 0.88 AS confidence, 0 AS place FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, p, 0.72, 1 FROM part, (SELECT unnest(['red', 'gear', 'old widget', 'ring']) AS p) WHERE regexp_matches(p_name, '(^|[^a-z0-9])' || p || '($|[^a-z0-9])'))
SELECT p_partkey, skill, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey, skill ORDER BY place) AS rn FROM w) WHERE rn = 1""")
def curated_phrases(spark, sf):
    """Declared skills, and behind them curated phrases that stand between word ends."""
    p = table(spark, sf, "part").withColumn("declared", F.when(F.col("p_size") > 25, F.split("p_name", " ")))
    return extract.phrases(p, "p_partkey", "p_name", "declared", ["red", "gear", "old widget", "ring"])


@query("alias_confidence", """WITH a AS (SELECT p_partkey, p_brand, length(p_name) AS n, p_size / 50.0 AS w FROM part), s AS (SELECT p_brand, p_partkey, greatest(0.5, least(0.99, least(0.98, 0.72 + least(n / 40.0, 0.12) + 0.14 * w)))::DOUBLE AS c FROM a)
SELECT p_brand, max(c) AS confidence, min(p_partkey) FILTER (WHERE c >= 0.9)::BIGINT AS first_sure, count(*) FILTER (WHERE greatest(0, least(0.92, 0.2 + 0.85 * c)) >= 0.9) AS calibrated FROM s GROUP BY 1""")
def alias_confidence(spark, sf):
    """How sure a match of an alias is, by its length and weight; the best for each skill."""
    c = extract.alias_confidence(F.length("p_name"), F.col("p_size") / F.lit(50.0))
    s = table(spark, sf, "part").select("p_brand", "p_partkey", c.alias("c"))
    return s.groupBy("p_brand").agg(F.max("c").alias("confidence"), F.min(F.when(F.col("c") >= 0.9, F.col("p_partkey"))).alias("first_sure"), F.count_if(clip(0.2 + 0.85 * F.col("c"), 0.0, 0.92) >= 0.9).alias("calibrated"))


@query("context_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM l WHERE length(line) BETWEEN 8 AND 260 AND NOT regexp_matches(line, '[0-9]|http|@'))
SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS size, min(i)::BIGINT AS first_line FROM k WHERE rn <= 8 GROUP BY 1""")
def context_lines(spark, sf):
    """The first eight lines of 8 to 260 characters without figures, links or addresses."""
    d = table(spark, sf, "documents").select("doc_id", F.slice(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("i"), x.alias("line"))), lambda x: F.length(x["line"]).between(8, 260) & ~x["line"].rlike("[0-9]|http|@")), F.lit(1), F.lit(8)).alias("own"))
    d = d.where(F.size("own") > 0)
    return d.select("doc_id", F.size("own").cast("long").alias("lines"), F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + F.length(x["line"])).alias("size"), F.col("own")[0]["i"].cast("long").alias("first_line"))


@query("label_keys", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || ' C++ ' || p_name), '[^a-z0-9+#. ]', ' ', 'g'), ' +', ' ', 'g')) AS label, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') || '|' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS group_key FROM part")
def label_keys(spark, sf):
    """Labels that keep the signs of names such as c++ and c#, and keys of slugs joined by a bar."""
    label = text.skill_label(F.concat_ws(" ", "p_brand", F.lit("C++"), "p_name"))
    return table(spark, sf, "part").select("p_partkey", label.alias("label"), F.concat_ws("|", text.slug(F.col("p_brand")), text.slug(F.col("p_name"))).alias("group_key"))


@query("type_lookup", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'full_time' WHEN '2-HIGH' THEN 'part_time' WHEN '3-MEDIUM' THEN 'contract' ELSE 'other' END AS kind FROM orders")
def type_lookup(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", extract.looked_up(F.col("o_orderpriority"), {"1-URGENT": "full_time", "2-HIGH": "part_time", "3-MEDIUM": "contract"}, "other").alias("kind"))


@query("module_codes", """WITH t AS (SELECT p_partkey, 'Module ABC' || (100 + p_size) || ' carries ' || p_size || ' credits at NQF level ' || (p_size // 10 + 4) || '; test ' || p_size || '%' AS t FROM part)
SELECT p_partkey, regexp_extract(t, '([A-Z]{3}[0-9]{3})', 1) AS code, regexp_extract(t, '([0-9]+) credits', 1)::INT AS credits, regexp_extract(t, 'NQF level ([0-9]+)', 1)::INT AS level, regexp_extract(t, '([0-9]+)%', 1)::INT AS weight FROM t""")
def module_codes(spark, sf):
    """Code, credits, level and weight of assessment, as texts tell them."""
    t = F.concat(F.lit("Module ABC"), F.col("p_size") + 100, F.lit(" carries "), "p_size", F.lit(" credits at NQF level "), F.floor(F.col("p_size") / 10) + 4, F.lit("; test "), "p_size", F.lit("%"))
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in extract.module_facts(t).items()])


@query("usefulness", """SELECT doc_id, score, score >= 8 AS useful FROM (SELECT doc_id, (CASE WHEN lang = 'en' THEN 4 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 3 ELSE 0 END + 2 * (contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'shall')::INT) - 8 * (contains(lower(text), 'http')::INT) - CASE WHEN length(text) < 120 THEN 8 ELSE 0 END)::INT AS score FROM documents)""")
def usefulness(spark, sf):
    """Points for what is known of a text and for terms of its field, less those for noise and shortness."""
    score = extract.usefulness(F.col("text"), [(F.col("lang") == "en", 4), (F.col("source").isNotNull(), 3)], good=["the", "tion", "shall"], noise=["http"])
    return table(spark, sf, "documents").select("doc_id", score.alias("score"), (score >= 8).alias("useful"))


@query("rule_labels", """WITH c AS (SELECT doc_id, ((length(text) - length(replace(text, 'tion', ''))) / 4)::INT AS n, contains(text, 'the') AS alias FROM documents) SELECT doc_id, CASE WHEN n >= 20 THEN 5 WHEN n >= 8 THEN 4 WHEN n >= 2 THEN 3 WHEN alias THEN 2 ELSE 1 END AS label FROM c""")
def rule_labels(spark, sf):
    """Labels from 1 to 5 by how often a term stands in the text, or an alias of it."""
    n = extract.occurrences(F.col("text"), "tion")
    return table(spark, sf, "documents").select("doc_id", F.when(n >= 20, 5).when(n >= 8, 4).when(n >= 2, 3).when(F.contains("text", F.lit("the")), 2).otherwise(1).alias("label"))


@query("trimmed_texts", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT d.doc_id, length(coalesce(string_agg(trim(line), ' / ' ORDER BY i) FILTER (WHERE length(trim(line)) >= 20 AND NOT contains(line, 'http')), '')) AS size FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY 1""")
def trimmed_texts(spark, sf):
    """Texts put together from their lines but the noisy ones."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 20) & ~F.contains(x, F.lit("http")))
    return table(spark, sf, "documents").select("doc_id", F.length(F.array_join(kept, " / ")).cast("long").alias("size"))


@query("title_names", "SELECT o_orderkey, regexp_replace('Job demand for ' || lower(o_orderpriority), '^(?i)job demand for ', '') AS name FROM orders")
def title_names(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", extract.title_name(F.concat(F.lit("Job demand for "), F.lower("o_orderpriority"))).alias("name"))


@query("explanations", "SELECT p_partkey, 'Demand for ' || p_name || ' is ' || CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END || ' (' || p_size || ' of 50).' AS why FROM part")
def explanations(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.format_string("Demand for %s is %s (%d of 50).", "p_name", F.when(F.col("p_size") > 25, "high").otherwise("low"), "p_size").alias("why"))


@query("employer_names", "SELECT page_id, regexp_extract(url, '://(?:www\\.|m\\.)?([a-z0-9-]+)', 1) AS name FROM pages")
def employer_names(spark, sf):
    """Whose page it is, by the first part of its host."""
    return table(spark, sf, "pages").select("page_id", F.lower(extract.employer(F.lit(None).cast("string"), F.col("url"))).alias("name"))


@query("file_names", "SELECT o_orderkey, 'P0211' AS series, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter FROM orders")
def file_names(spark, sf):
    """Series, year and quarter from the names of files of a statistical office."""
    nth = F.element_at(F.array(F.lit("1st"), F.lit("2nd"), F.lit("3rd"), F.lit("4th")), F.quarter("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in extract.file_facts(F.concat(F.lit("P0211"), nth, F.lit("Quarter"), F.year("o_orderdate"), F.lit(".pdf"))).items()])


@query("table_classes", "SELECT p_partkey, CASE WHEN contains(p_name, 'red') AND contains(p_name, 'gear') THEN 'red gears' WHEN contains(p_name, 'bolt') THEN 'bolts' ELSE 'other' END AS class FROM part")
def table_classes(spark, sf):
    """The first class of which a title holds all terms."""
    return table(spark, sf, "part").select("p_partkey", extract.all_terms(F.col("p_name"), [("red gears", ["red", "gear"]), ("bolts", ["bolt"])], "other").alias("class"))


@query("inferred_units", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'percent' WHEN contains(p_name, 'ring') THEN 'thousand' ELSE 'count' END AS unit, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'size' ELSE 'kind' END AS dimension, lower(p_type) || ' by ' || lower(p_brand) AS indicator FROM part")
def inferred_units(spark, sf):
    """Unit, kind of dimension and name of an indicator, from its texts."""
    title = F.concat_ws(" ", F.when(F.col("p_size") >= 40, "Rate (%)"), F.when(F.contains("p_name", F.lit("ring")), "Thousand"))
    return table(spark, sf, "part").select("p_partkey", extract.unit(title).alias("unit"), F.when(F.col("p_type").isin("SMALL", "LARGE"), "size").otherwise("kind").alias("dimension"), F.concat_ws(" by ", F.lower("p_type"), F.lower("p_brand")).alias("indicator"))


@query("failure_kinds", "SELECT event_id, CASE WHEN value < 5 THEN 'timeout' WHEN value < 20 THEN 'encoding' WHEN value < 50 THEN 'schema' ELSE 'unknown' END AS kind FROM events WHERE event_type = 'error'")
def failure_kinds(spark, sf):
    """Kinds of failures by what their messages say."""
    said = F.when(F.col("value") < 5, "Read timed out").when(F.col("value") < 20, "'utf-8' codec can't decode byte").when(F.col("value") < 50, "missing column x").otherwise("boom")
    return table(spark, sf, "events").where("event_type = 'error'").select("event_id", extract.failure(said).alias("kind"))


@query("newest_evidence", "SELECT o_orderkey, greatest(o_orderdate::DATE, coalesce(max(l_shipdate)::DATE, o_orderdate::DATE)) ::VARCHAR AS newest, make_date(year(o_orderdate), (quarter(o_orderdate) - 1) * 3 + 1, 1)::VARCHAR AS quarter_start, make_date(year(o_orderdate), 12, 31)::VARCHAR AS year_end, (date_trunc('month', o_orderdate) - INTERVAL 3 MONTH)::DATE::VARCHAR AS three_back FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def newest_evidence(spark, sf):
    """The newest date of all evidence; days that stand for quarters and years; months back."""
    last = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("last"))
    o = table(spark, sf, "orders").join(last, F.expr("l_orderkey = o_orderkey"), "left").withColumn("day", F.to_date("o_orderdate"))
    return o.select("o_orderkey", *[c.cast("string").alias(n) for n, c in {"newest": F.array_max(F.array("day", F.coalesce("last", "day"))), "quarter_start": F.make_date(F.year("day"), (F.quarter("day") - 1) * 3 + 1, F.lit(1)), "year_end": F.make_date(F.year("day"), F.lit(12), F.lit(31)), "three_back": F.add_months(F.trunc("day", "month"), -3)}.items()])


@query("record_scores", "SELECT p_partkey, 0.35 + CASE WHEN p_name <> '' THEN 0.15 ELSE 0 END + CASE WHEN p_size > 10 THEN 0.20 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 0.20 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 0.05 ELSE 0 END + CASE WHEN p_brand LIKE '%1%' THEN 0.05 ELSE 0 END >= 0.745 AS complete FROM part")
def record_scores(spark, sf):
    """How complete a record is, by weights of its parts."""
    score = extract.weighted([(F.col("p_name") != "", 0.15), (F.col("p_size") > 10, 0.20), (F.col("p_retailprice") > 1000, 0.20), (F.col("p_type") == "PROMO", 0.05), (F.col("p_brand").like("%1%"), 0.05)], base=0.35)
    return table(spark, sf, "part").select("p_partkey", (score >= 0.745).alias("complete"))


@query("heuristic_forecast", "SELECT p_partkey, unnest(range(1, 13))::INT AS month, p_size * (1 + 0.02::DOUBLE * unnest(range(1, 13))) AS forecast, least(0.30, 0.10 + 0.01 * unnest(range(1, 13)))::DOUBLE AS band FROM part WHERE p_size <= 5")
def heuristic_forecast(spark, sf):
    """Twelve months ahead by a steady growth, with a band that widens."""
    p = table(spark, sf, "part").where("p_size <= 5").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    band = F.least(F.lit("0.30").cast("decimal(4,2)"), F.lit("0.10").cast("decimal(4,2)") + F.lit("0.01").cast("decimal(4,2)") * F.col("month")).cast("double")
    return p.select("p_partkey", "month", (F.col("p_size") * (1 + 0.02 * F.col("month"))).alias("forecast"), band.alias("band"))


@query("training_rows", """SELECT doc_id, quality, (quality * 4 + 1 - 1) / 4.0::DOUBLE AS target, length(text) AS size, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS distinct_words, n_chars / 1000.0::DOUBLE AS thousands, lang = 'en' AS english,
 0.55 * quality + 0.45 * toxic >= 0.5 AS baseline FROM labels JOIN documents USING (doc_id)""")
def training_rows(spark, sf):
    """Features of labelled texts and of their context, the target from 0 to 1, and a weighted baseline."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    words = text.tokens(F.col("text"))
    return j.select("doc_id", "quality", extract.target(F.col("quality") * 4 + 1).alias("target"), F.length("text").cast("long").alias("size"), F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct_words"), (F.col("n_chars") / 1000.0).alias("thousands"), (F.col("lang") == "en").alias("english"), (0.55 * F.col("quality") + 0.45 * F.col("toxic") >= 0.5).alias("baseline"))


@query("first_items", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], '_') AS first_words FROM documents")
def first_items(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 5), "_").alias("first_words"))


@query("promoted_headers", "SELECT p_partkey, p_name AS name, p_name AS name_2, p_size::VARCHAR AS size FROM part")
def promoted_headers(spark, sf):
    """Rows of cells named by a header row, in which equal names get a number."""
    cells = F.array("p_name", "p_name", F.col("p_size").cast("string"))
    names = extract.unique_names(["Name", "name ", "Size"])
    return table(spark, sf, "part").select("p_partkey", *[cells[i].alias(n) for i, n in enumerate(names)])


@query("profile_facts", """SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)', 1), '') AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def profile_facts(spark, sf):
    """What a page tells of its subject: title, topics that it links, paragraphs."""
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.regexp_extract(h, "<title>([^<]*)", 1), F.lit("")).alias("title"), F.size(F.regexp_extract_all(h, F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.size(F.regexp_extract_all(h, F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"))


def _names(rows, of):
    """Distinct names, each with its least key as id, a category and how often it stands."""
    return rows.where(f"{of} <> ''").groupBy(F.col(of).alias("name")).agg(F.min("key").alias("id"), F.min("category").alias("category"), F.count("*").alias("uses"))


@query("scored_duplicates")
def scored_duplicates(spark, sf):
    """Long words of conversations that may be one: pairs to merge, with score and reasons. Likeness of matching blocks is not in SQL; tests compare by brute force."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("role").alias("category"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0))).alias("word"))
    names = _names(c, "word").drop("id").withColumn("id", F.col("name"))
    plural = names.select("id", F.concat("name", F.lit("s")).alias("alias"))
    return duplicates.duplicates(names, plural.union(names.select("id", "name")), least=0.9).select("keep", "merge", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query("line_diffs")
def line_diffs(spark, sf):
    """Differences of lines between a page's neighbours of a conversation, as unified diffs; tests compare by the library itself."""
    c = series.top_of(table(spark, sf, "conversations"), ["conv_id"], ["turn"], 2).groupBy("conv_id").agg(F.min_by("text", "turn").alias("old"), F.max_by("text", "turn").alias("new"))
    return c.select("conv_id", extract.line_diff("old", "new").alias("diff"))
