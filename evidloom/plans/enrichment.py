"""Hashed vectors of texts, enrichment and retrieval by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions.text import tokens
from evidloom.operators import dictionary, enrichment
from evidloom.plans.registry import query, table


def _sql(name: str, rows: str) -> str:
    """CTE ``name`` (id, v) from rows (id, text)."""
    return f"""{name}_w AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM ({rows})) GROUP BY ALL),
{name}_s AS (SELECT id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS i, sum(CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN n ELSE -n END)::DOUBLE AS s FROM {name}_w GROUP BY ALL),
{name}_m AS (SELECT id, map_from_entries(list((i, s))) AS m, sqrt(sum(s * s)) AS norm FROM {name}_s GROUP BY 1 HAVING sum(s * s) > 0),
{name} AS (SELECT id, list_transform(range(64), lambda i: round(coalesce(m[i], 0) / norm, 8)) AS v FROM {name}_m)"""


_UNIT = "list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))"


def _vectors(rows, key):
    return enrichment.hashed_vectors(rows, key, tokens(F.col("text"))).select(F.col(key).alias("id"), "v")


@query("hashed_vectors", f"WITH {_sql('d', 'SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, v[1] AS first, v[64] AS last, round(list_sum(list_transform(range(64), lambda i: i * v[i + 1])), 5) + 0 AS mark FROM d")
def hashed_vectors(spark, sf):
    """Every text as a vector of hashed words: two of its places and a weighted sum of all."""
    v = _vectors(table(spark, sf, "documents"), "doc_id")
    mark = F.aggregate(F.transform("v", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return v.select(F.col("id").alias("doc_id"), F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"), (F.round(mark, 5) + 0.0).alias("mark"))


def _nearest_sql(asked: str, of: str, k: int, least: float) -> str:
    return f"(SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, s, round(s, 6) AS score FROM (SELECT q.id AS query_id, t.id, round(list_dot_product(q.u, t.u), 12) AS s FROM (SELECT id, {_UNIT} AS u FROM {asked}) q, (SELECT id, {_UNIT} AS u FROM {of}) t) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= {2 * k}) WHERE s >= {least} QUALIFY rank <= {k})"


@query("enriched_postings", f"""WITH {_sql('q', 'SELECT doc_id AS id, text FROM documents')}, {_sql('s', "SELECT item_id::VARCHAR AS id, text FROM benchmark")}, {_sql('o', "SELECT 'c' || conv_id AS id, string_agg(text, ' ') AS text FROM conversations WHERE conv_id < 20 GROUP BY 1")},
dw AS (SELECT doc_id AS id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents), declared AS (SELECT id, item_id::VARCHAR AS skill FROM dw, benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0 AND contains(t, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:4], ' ') || ' ')),
links AS (SELECT 'c' || (regexp_replace(item_id::VARCHAR, '[^0-9]', '', 'g')::BIGINT % 20) AS occupation, item_id::VARCHAR AS skill FROM benchmark),
h AS {_nearest_sql('q', 's', 10, 0.35)}, j AS {_nearest_sql('q', 'o', 3, 0.35)}, b AS (SELECT query_id, id AS occupation FROM j WHERE rank = 1),
x AS (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS skills FROM h WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.id = query_id AND d.skill = h.id) GROUP BY 1), y AS (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS occupations FROM j GROUP BY 1),
z AS (SELECT query_id, string_agg(skill, ',' ORDER BY skill) AS linked FROM b JOIN links USING (occupation) WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.id = query_id AND d.skill = links.skill) GROUP BY 1)
SELECT q.id AS doc_id, coalesce(skills, '') AS skills, coalesce(occupations, '') AS occupations, coalesce(linked, '') AS linked FROM q LEFT JOIN x ON x.query_id = q.id LEFT JOIN y ON y.query_id = q.id LEFT JOIN z ON z.query_id = q.id""")
def enriched_postings(spark, sf):
    """For every text the benchmark items and conversations that are nearest by their words; items whose first four words stand in it are declared."""
    d, b, c = (table(spark, sf, t) for t in ("documents", "benchmark", "conversations"))
    b = b.select(F.col("item_id").cast("string").alias("item"), "text")
    jobs = c.where("conv_id < 20").groupBy(F.concat(F.lit("c"), F.col("conv_id")).alias("conv")).agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    begins = b.select(F.col("item").alias("skill"), F.array_join(F.slice(tokens(F.col("text")), 1, 4), " ").alias("name")).where("name <> ''")
    found = dictionary.dictionary_matches(d, dictionary.automata(begins, "name"), "text", ["doc_id"])
    declared = found.join(begins, "name").select(F.col("doc_id").alias("id"), "skill")
    links = b.select(F.concat(F.lit("c"), F.regexp_replace("item", "[^0-9]", "").cast("long") % 20).alias("occupation"), F.col("item").alias("skill"))
    out = enrichment.enriched(_vectors(d, "doc_id"), _vectors(b, "item"), _vectors(jobs, "conv"), links, declared)
    return out.select(F.col("id").alias("doc_id"), *[F.array_join(x, ",").alias(x) for x in ("skills", "occupations", "linked")])


@query("answers", f"""WITH {_sql('q', "SELECT conv_id AS id, text FROM conversations WHERE turn = 0 AND conv_id % 100 = 0")}, {_sql('d', "SELECT 'document:' || doc_id AS id, text FROM documents WHERE n_chars >= 200")}, {_sql('p', "SELECT 'page:' || page_id AS id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g') AS text FROM pages")},
u AS (SELECT * FROM d UNION ALL SELECT * FROM p), r AS {_nearest_sql('q', 'u', 5, 0.0)} SELECT query_id, rank::INT AS rank, string_split(id, ':')[1] AS kind, string_split(id, ':')[2] AS id, score FROM r""")
def answers(spark, sf):
    """What documents and pages are nearest to the first turn of the conversations whose number is divisible by 100."""
    asked = table(spark, sf, "conversations").where("turn = 0 AND conv_id % 100 = 0")
    plain = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "&[a-z]+;", " ")
    pages = table(spark, sf, "pages").select("page_id", plain.alias("text"))
    sources = {"document": _vectors(table(spark, sf, "documents").where("n_chars >= 200"), "doc_id"), "page": _vectors(pages, "page_id")}
    return enrichment.retrieved(_vectors(asked, "conv_id"), sources)
