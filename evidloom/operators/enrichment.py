"""Texts as vectors of hashed words, what a taxonomy has for them, and what answers a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidloom.operators.vector_index import search, vector_index
from evidloom.tables import stored


def hashed_vectors(texts: DataFrame, key: str, words: Column, size: int = 64) -> DataFrame:
    """(key, v): signed hashing of words into ``size`` places, of unit length, rounded to eight digits.

    A word's place is the first four bytes of its SHA-256 modulo ``size``, its sign the fifth byte's parity. Words are counted
    before anything is shuffled. Texts without words, or whose words cancel out, have no direction: their row is left out.
    """
    each = texts.select(key, F.explode(words).alias("_w")).groupBy(key, "_w").agg(F.count("*").alias("_n"))
    digest = F.sha2("_w", 256)
    number = lambda first, n: F.conv(F.substring(digest, first, n), 16, 10).cast("long")
    placed = each.select(key, (number(1, 8) % size).cast("int").alias("_i"), F.when(number(9, 2) % 2 == 0, F.col("_n")).otherwise(-F.col("_n")).alias("_s"))
    sums = placed.groupBy(key, "_i").agg(F.sum("_s").cast("double").alias("_s"))
    whole = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_s"))).alias("_m"), F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.round(F.coalesce(F.try_element_at("_m", i), F.lit(0.0)) / F.col("_norm"), 8))
    return whole.where("_norm > 0").select(key, vector.alias("v"))


def enriched(postings: DataFrame, skills: DataFrame, occupations: DataFrame, links: DataFrame, declared: DataFrame, skill_k: int = 10, occupation_k: int = 3, least: float = 0.35) -> DataFrame:
    """(id, skills, occupations, linked): for each posting (id, v) the nearest skills that it does not declare, the nearest occupations, and the skills linked with the best.

    ``skills`` and ``occupations`` are (id, v) with text ids, ``links`` (occupation, skill), ``declared`` (id, skill). Postings that match nothing have empty lists.
    """
    postings, _ = stored(postings, "postings")  # read by both searches, twice each, and by the result
    hits = [search(vector_index(t, "id", "v", cells=1), postings, "id", "v", k=k, least=least, exact=True).withColumnRenamed("id", "hit") for t, k in ((skills, skill_k), (occupations, occupation_k))]
    listed = lambda: F.transform(F.array_sort(F.collect_list(F.struct("rank", "hit"))), lambda x: x["hit"])
    said = declared.select(F.col("id").alias("query_id"), F.col("skill").alias("hit")).distinct()
    own = hits[0].join(said, ["query_id", "hit"], "left_anti").groupBy("query_id").agg(listed().alias("skills"))
    jobs = hits[1].groupBy("query_id").agg(listed().alias("occupations"))
    best = hits[1].where("rank = 1").select("query_id", F.col("hit").alias("occupation"))
    linked = best.join(links, "occupation").select("query_id", F.col("skill").alias("hit")).distinct().join(said, ["query_id", "hit"], "left_anti")
    linked = linked.groupBy("query_id").agg(F.array_sort(F.collect_list("hit")).alias("linked"))
    none = F.array().cast("array<string>")
    out = postings.select(F.col("id").alias("query_id")).distinct().join(own, "query_id", "left").join(jobs, "query_id", "left").join(linked, "query_id", "left")
    return out.select(F.col("query_id").alias("id"), *[F.coalesce(c, none).alias(c) for c in ("skills", "occupations", "linked")])


def retrieved(questions: DataFrame, sources: dict[str, DataFrame], k: int = 5, least: float = 0.0) -> DataFrame:
    """(query_id, rank, kind, id, score): the k nearest of several kinds of sources together, for each question (id, v)."""
    every = None
    for kind, rows in sources.items():
        own = rows.select(F.concat_ws(":", F.lit(kind), F.col("id").cast("string")).alias("id"), "v")
        every = own if every is None else every.unionByName(own)
    questions, _ = stored(questions, "questions")
    found = search(vector_index(every, "id", "v", cells=1), questions, "id", "v", k=k, least=least, exact=True)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", F.substring_index("id", ":", 1).alias("kind"), F.expr("substr(id, instr(id, ':') + 1)").alias("id"), "score")
