"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidloom.llm import secret_scan, url_filter
from evidloom.llm.alignment import alignment
from evidloom.llm.decontaminate import contamination
from evidloom.llm.fingerprints import edit_fingerprints
from evidloom.llm.impact_index import impact_index, top_k
from evidloom.llm.language import language
from evidloom.llm.mixing import mixture
from evidloom.llm.ngram_join import ngram_join
from evidloom.llm.periodic import periodic_runs
from evidloom.llm.quality import quality
from evidloom.llm.secret_scan import secrets
from evidloom.llm.token_store import token_store
from evidloom.llm.toxicity import toxicity
from evidloom.llm.url_filter import Rule, judged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


@_query
def op3_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op4_pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"))


@_query
def op5_language_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(_table(spark, sf_dir, "documents"))


@_query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


@_query
def op7_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


RULES = [
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
]


@_query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "pages"), RULES)


@_query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).documents


@_query
def op12_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(*impact_index(_table(spark, sf_dir, "embeddings")), "id % 50 = 0")


def planted_period(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """Where and with which period a document of n words repeats itself in this query; nine of ten, and those without id, do not."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    return g % n, 1 + (n - g % n) // (3 + g % 8)


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"), edit=planted_period)


#: Words of A-Z lower-cased text, as RE2 and Java write the class alike.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

SQL["op6_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, g, hash(g) AS h FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b ON a.h = b.h AND a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

SQL["op4_pareto_mixture"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':0'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
f AS (SELECT *, (sum(size) OVER () - coalesce(sum(3 * size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS unit
  FROM s WINDOW o AS (ORDER BY 3 * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, size AS source_size, least(3 * size, w * (SELECT max(unit) FROM f)) AS target FROM f),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS due FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(due) AS whole, due - floor(due) AS p FROM r),
k AS (SELECT *, u * (1 - p) / (u * (1 - p) + (1 - u) * p) AS rank, target - sum(whole * size) OVER (PARTITION BY source) AS room FROM q),
c AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source, p > 0 ORDER BY rank, doc_id NULLS FIRST, h ROWS UNBOUNDED PRECEDING) - size / 2 AS mid FROM k)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target, ((whole + CASE WHEN p > 0 AND mid <= room THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""

SQL["op8_decontaminate"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS g FROM b),
x AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM g))),
y AS (SELECT DISTINCT doc_id, item_id, x.m, i FROM x JOIN g ON x.g = g.g AND x.m = g.m),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM y) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM y) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _url_sql() -> str:
    """Verdicts by rules, and by a closure over the pages' canonical links and refreshes."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), '{up}', '{low}')"
    path = lambda u: f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    rest = lambda u: f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    resource = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || CASE WHEN {rest(u)} = '' THEN '/' ELSE {rest(u)} END END"
    rules = sorted(RULES, key=lambda r: (-len(r.name), r.allow))
    fits = lambda r, u: f"({host(u)} = '{r.host}' OR ends_with({host(u)}, '.{r.host}')) AND starts_with({path(u)}, '{r.path}')"
    pick = lambda u, value: "CASE " + " ".join(f"WHEN {fits(r, u)} THEN {value(r)}" for r in rules) + " END"
    allowed = lambda u: pick(u, lambda r: str(r.allow).lower())
    q = lambda p: p.replace("'", "''")
    tags = lambda tag, kind, to: f"list_filter(list_transform(list_filter(regexp_extract_all(html, '{q(tag)}'), lambda t: regexp_matches(t, '{q(kind)}')), lambda t: regexp_extract(t, '{q(to)}', 1)), lambda u: u <> '')"
    origin = "regexp_extract(a, '(?s)^.*?://[^/?#]*', 0)"
    folder = f"{origin} || coalesce(nullif(regexp_extract({path('a')}, '(?s)^.*/', 0), ''), '/')"
    absolute = f"CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(a, '(?s)^(.*?:)//', 1) || t WHEN starts_with(t, '/') THEN {origin} || t ELSE {folder} || t END"
    return f"""
WITH RECURSIVE t AS (SELECT url AS a, unnest(list_concat({tags(url_filter.LINK, url_filter.CANONICAL, url_filter.HREF)}, {tags(url_filter.META, url_filter.REFRESH, url_filter.MOVED)})) AS t FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
l AS (SELECT a, {absolute} AS b FROM t), e AS (SELECT a, b, {resource('a')} AS ra, {resource('b')} AS rb FROM l),
u AS (SELECT ra, rb FROM e WHERE ra <> rb UNION SELECT rb, ra FROM e WHERE ra <> rb), r AS (SELECT ra AS x, ra AS y FROM u UNION SELECT r.x, u.rb FROM r JOIN u ON r.y = u.ra),
n AS (SELECT {resource('url')} AS y FROM pages WHERE NOT {allowed('url')} UNION SELECT {resource('x')} FROM (SELECT a AS x FROM e WHERE ra <> rb UNION SELECT b FROM e WHERE ra <> rb) WHERE NOT {allowed('x')}),
bad AS (SELECT DISTINCT x FROM r JOIN n ON r.y = n.y)
SELECT page_id, {host('url')} AS host, {path('url')} AS path, {pick('url', lambda r: f"'{r.name}'")} AS rule, CASE WHEN coalesce({allowed('url')}, {resource('url')} NOT IN (SELECT x FROM bad), true) THEN 'allow' ELSE 'block' END AS verdict FROM pages"""


SQL["op10_url_filter"] = _url_sql()


def _spans_sql(kind: str, pattern: str, group: int, low: int, high: int | None = None) -> str:
    """Rows (doc_id, kind, s, e) of the matches of which ``group`` has low (to high) characters."""
    p = pattern.replace("'", "''")
    most = f" AND length(v[i]) <= {high}" if high else ""
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + length(m[i]) AS e FROM (SELECT doc_id, m, v, i, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d))) WHERE length(v[i]) >= {low}{most}"""


SQL["op9_secret_scan"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS ({_spans_sql('assign', secret_scan.ASSIGN, 1, 12)} UNION ALL {_spans_sql('access', secret_scan.ACCESS, 0, 18)} UNION ALL {_spans_sql('hex', secret_scan.HEX, 0, 16)}),
p AS ({_spans_sql('part', secret_scan.WEAK_PART, 1, 6)} UNION ALL {_spans_sql('part', secret_scan.ASSIGN, 1, 6, 11)} UNION ALL {_spans_sql('id', secret_scan.WEAK_ID, 1, 3)} UNION ALL {_spans_sql('endpoint', secret_scan.ENDPOINT, 0, 4)}),
near AS (SELECT x.doc_id, x.kind, x.s, x.e, y.kind AS k FROM p x JOIN (SELECT * FROM p UNION ALL SELECT * FROM b WHERE kind = 'access') y ON x.doc_id = y.doc_id AND abs(x.s - y.s) <= 200 WHERE x.kind = 'part'),
l AS (SELECT doc_id, s, e FROM near GROUP BY ALL HAVING bool_or(k = 'access') OR (bool_or(k = 'id') AND bool_or(k = 'endpoint'))),
a AS (SELECT * FROM b UNION ALL SELECT doc_id, 'linked_part', s, e FROM l UNION ALL SELECT DISTINCT p.doc_id, 'linked_' || kind, p.s, p.e FROM p JOIN l ON p.doc_id = l.doc_id AND abs(p.s - l.s) <= 200 WHERE kind <> 'part'),
o AS (SELECT *, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 WHEN 'linked_id' THEN 3 WHEN 'linked_part' THEN 4 ELSE 5 END AS place, kind || ':' || s || ':' || e AS name FROM a)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY s, place, e) FILTER (WHERE place < 3), '')) AS base_sha256, coalesce(string_agg(name, ',' ORDER BY s, place, e), '') AS spans
FROM d LEFT JOIN o ON d.doc_id = o.doc_id GROUP BY d.doc_id
"""

SQL["op12_impact_top_k"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.r AS c, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, c))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
