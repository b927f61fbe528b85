"""Joins between texts, taxonomies and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidloom.operators.dictionary import automata, dictionary_matches


def fallback_join(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], take: str) -> DataFrame:
    """``take`` of the row that matches on the first pair of columns, else on the second; both joins are by key."""
    a = right.select(F.col(first[1]).alias(first[0]), F.col(take).alias("_a")).dropDuplicates([first[0]])
    b = right.select(F.col(second[1]).alias(second[0]), F.col(take).alias("_b")).dropDuplicates([second[0]])
    return left.join(a, first[0], "left").join(b, second[0], "left").withColumn(take, F.coalesce("_a", "_b")).drop("_a", "_b")


def alias_matches(texts: DataFrame, aliases: DataFrame, text: str, alias: str, key: list[str]) -> DataFrame:
    """(key, alias, hits, first_at) of the aliases that stand in texts as whole words, by automata over all aliases."""
    found = dictionary_matches(texts, automata(aliases, alias), text, key)
    return found.select(*key, F.col("name").alias(alias), "hits", F.col("first_at").cast("int").alias("first_at"))


def jaccard_pairs(sets: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """(a, b, jaccard) of the pairs of rows whose sets are that alike.

    Such sets share one of the first ``n - ceil(least n) + 1`` of their items, rarest first; only those
    are joined, and the sets of the pairs found are then compared.
    """
    rows = sets.select(F.col(key).alias("_k"), F.col(items).alias("_s")).where(F.size("_s") > 0)
    each = rows.select("_k", F.size("_s").alias("_n"), F.explode("_s").alias("_x"))
    rare = each.join(each.groupBy("_x").agg(F.count("*").alias("_df")), "_x")
    place = F.row_number().over(Window.partitionBy("_k").orderBy("_df", "_x"))
    prefix = rare.withColumn("_at", place).where(F.col("_at") <= F.col("_n") - F.ceil(F.col("_n") * F.lit(least)) + 1).select("_k", "_x")
    a, b = prefix.select(F.col("_k").alias("a"), "_x"), prefix.select(F.col("_k").alias("b"), "_x")
    pairs = a.join(b, "_x").where("a < b").select("a", "b").distinct()
    both = pairs.join(rows.select(F.col("_k").alias("a"), F.col("_s").alias("_sa")), "a").join(rows.select(F.col("_k").alias("b"), F.col("_s").alias("_sb")), "b")
    shared = F.size(F.array_intersect("_sa", "_sb"))
    return both.select("a", "b", (shared / (F.size("_sa") + F.size("_sb") - shared)).alias("jaccard")).where(F.col("jaccard") >= least)


def containing_range(points: DataFrame, ranges: DataFrame, group: str, point: str, start: str, end: str, take: list[str]) -> DataFrame:
    """For each point the latest range of its group that starts at or before it, and whether it contains it.

    Points and range starts are sorted together, and the last start is carried on: an as-of join
    by one window, without pairs.
    """
    p = points.select(group, F.col(point).alias("_x"), F.lit(1).alias("_kind"), *[c for c in points.columns if c not in (group, point)])
    r = ranges.select(group, F.col(start).alias("_x"), F.lit(0).alias("_kind"), F.struct(F.col(end).alias("_end"), *take).alias("_range"))
    both = p.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy("_x", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_range", F.last("_range", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select(group, F.col("_x").alias(point), *[c for c in points.columns if c not in (group, point)], *[F.col(f"_range.{c}").alias(c) for c in take], (F.coalesce(F.col("_range._end") >= F.col("_x"), F.lit(False))).alias("inside"))


def duplicate_candidates(df: DataFrame, key: str, keys: list[Column], most: int = 100) -> DataFrame:
    """Distinct pairs of rows that share one of several keys; a key of more than ``most`` rows names no duplicates.

    That limit is part of what the operator computes: a key so common says nothing.
    """
    rows = df.select(F.col(key).alias("_id"), F.explode(F.array_distinct(F.array(*keys))).alias("_key")).where("_key IS NOT NULL AND _key <> ''").distinct()
    sized = rows.join(rows.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n").between(2, most)), "_key")
    a, b = sized.select("_key", F.col("_id").alias("a")), sized.select("_key", F.col("_id").alias("b"))
    return a.join(b, "_key").where("a < b").select("a", "b").distinct()


def overlap_scores(left: DataFrame, right: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """Weighted Jaccard of each group of ``left`` with the demanded items of ``right``, coverage and gap."""
    have = left.select(group, item).distinct()
    wanted = right.select(item, weight)
    total = wanted.agg(F.sum(weight).alias("_total"))
    g = have.join(wanted, item, "left").groupBy(group).agg(F.sum(F.coalesce(weight, F.lit(0.0))).alias("_shared"), F.count("*").alias("items"), F.count_if(F.col(weight).isNull()).alias("_extra"))
    g = g.join(F.broadcast(total))
    return g.select(group, "items", F.round(F.col("_shared") / (F.col("_total") + F.col("_extra")), 4).alias("alignment"), F.round(F.col("_shared") / F.col("_total"), 4).alias("coverage"), F.round(1 - F.col("_shared") / F.col("_total"), 4).alias("gap"))


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet; of equal keys one."""
    return incoming.join(existing.select(key).distinct(), key, "left_anti").dropDuplicates([key])
