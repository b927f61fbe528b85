"""Nearest vectors, exactly and by an index; a whole dictionary in whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions import text
from evidloom.operators import dictionary, vector_index
from evidloom.plans.registry import query, table

_UNIT = "u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) WHERE len(e) > 0 AND list_dot_product(e, e) > 0)"


def _index(spark, sf, **how):
    return vector_index.vector_index(table(spark, sf, "embeddings"), "vec_id", "embedding", **how)


def _asked(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0")


@query("vector_top", f"""WITH {_UNIT}, s AS (SELECT q.vec_id AS query_id, u.vec_id AS id, round(list_dot_product(q.v, u.v), 12) AS score FROM u q, u WHERE q.vec_id % 100 = 0),
f AS (SELECT query_id, id, score AS s, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, id, score FROM f WHERE rn <= 40 AND s >= 0.05) SELECT * FROM r WHERE rank <= 20""")
def vector_top(spark, sf):
    """The twenty nearest rows of every row whose id is divisible by 100, by exact search over all slices."""
    return vector_index.search(_index(spark, sf, cells=1), _asked(spark, sf), "vec_id", "embedding", k=20, least=0.05, exact=True)


@query("vector_index_top")
def vector_index_top(spark, sf):
    """The same by the index's nearest cells alone; tests measure its recall."""
    return vector_index.search(_index(spark, sf), _asked(spark, sf), "vec_id", "embedding", k=20, least=0.05)


@query("vector_index_recall")
def vector_index_recall(spark, sf):
    """Of each query's exact rows, how many the index finds, with the number of probed cells."""
    index, asked = _index(spark, sf), _asked(spark, sf)
    found, exact = (vector_index.search(index, asked, "vec_id", "embedding", k=20, exact=x) for x in (False, True))
    return vector_index.recall(found, exact).withColumn("recall", F.round(F.col("shared") / F.col("wanted"), 4)).withColumn("probes", F.lit(index.probes))


@query("dictionary_matches", """WITH b AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), a AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS alias FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, (SELECT unnest([1, 2, 3, 4]) AS n))),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), g AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS hits FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL)
SELECT doc_id, count(*) AS aliases, sum(hits)::BIGINT AS hits, max(len(string_split(alias, ' '))) AS longest, md5(string_agg(alias, ',' ORDER BY alias)) AS digest FROM g JOIN a ON g = alias GROUP BY 1""")
def dictionary_matches(spark, sf):
    """Every phrase of one to four words of the benchmark, looked for in every whole text."""
    words = table(spark, sf, "benchmark").select(text.tokens(F.col("text")).alias("w"))
    phrase = lambda n: lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")
    grams = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), phrase(n)) for n in (1, 2, 3, 4)]))
    own = words.where("size(w) >= 4").select(F.explode(grams).alias("alias")).distinct()
    found = dictionary.dictionary_matches(table(spark, sf, "documents"), dictionary.automata(own, "alias"), "text", ["doc_id"])
    longest = F.max(F.size(F.split("name", " "))).cast("long")
    return found.groupBy("doc_id").agg(F.count("*").alias("aliases"), F.sum("hits").alias("hits"), longest.alias("longest"), F.md5(F.array_join(F.array_sort(F.collect_list("name")), ",")).alias("digest"))
