"""Signals, their evidence, and recommendations from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidloom.functions.numbers import exact_mean


def signals(rows: DataFrame, keys: list[str], source: str, confidence: str, all_of: str, any_of: str) -> DataFrame:
    """A signal for each key: evidence, sources with their counts, mean confidence, two flags, and demand relative to the largest.

    Rows are first aggregated by key and source, so the histogram is put together from a row a source.
    """
    conf = F.col(confidence).cast("decimal(18,4)")
    fine = rows.groupBy(*keys, source).agg(F.count("*").alias("_n"), F.sum(conf).alias("_c"), F.bool_and(all_of).alias("_all"), F.bool_or(any_of).alias("_any"))
    histogram = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(source, "_n"))), lambda x: F.concat_ws(":", x[source], x["_n"])), ",")
    out = fine.groupBy(*keys).agg(F.sum("_n").alias("evidence"), histogram.alias("sources"), (F.sum("_c").cast("double") / F.sum("_n")).alias("confidence"), F.bool_and("_all").alias("all_of"), F.bool_or("_any").alias("any_of"))
    most = out.agg(F.max("evidence").alias("_most"))
    return out.join(F.broadcast(most)).withColumn("demand", F.col("evidence").cast("double") / F.col("_most")).drop("_most")


def mean_of_union(a: DataFrame, b: DataFrame, key: str, threshold: float) -> DataFrame:
    """Mean demand and confidence of each key over both tables; a gap from ``threshold`` on, else coverage."""
    m = a.unionByName(b).groupBy(key).agg(F.count("*").alias("n"), exact_mean("demand").alias("demand"), exact_mean("confidence").alias("confidence"))
    return m.withColumn("kind", F.when(F.col("demand") >= threshold, "gap").otherwise("coverage"))


def reconciled(received: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """Rows received and landed by key, the shortfall, and whether they agree (null where nothing landed)."""
    r, n = (x.groupBy(key).agg(F.count("*").alias(name)) for x, name in ((received, "received"), (landed, "landed")))
    return r.join(n, key, "left").withColumn("shortfall", F.col("received") - F.coalesce("landed", F.lit(0))).withColumn("reconciles", F.col("received") == F.col("landed"))


def by_rules(rows: DataFrame, skills: DataFrame, row_id: str, skill: str, rules: list[tuple[str, float]]) -> DataFrame:
    """(row, skill, rule, confidence) by the first of ``rules``, (column, confidence), in which both agree.

    Each rule is an equi-join; what is emitted are matches, never all pairs. Rows that hold the same values (as all rows
    of an id do, taken together) match alike, so that rules are tried once for each set of values and rows look theirs up.
    """
    columns = list(dict.fromkeys(c for c, _ in rules))
    valued = rows.groupBy(row_id).agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("_values"))
    each = valued.select("_values").distinct().select("_values", F.explode("_values").alias("_v"))
    found = [each.select("_values", F.col("_v")[c].alias(c)).join(skills.select(skill, c).distinct(), c).select("_values", skill, F.lit(k).alias("rule")) for k, (c, _) in enumerate(rules, 1)]
    best = reduce(DataFrame.unionByName, found).groupBy("_values", skill).agg(F.min("rule").alias("rule"))
    confidence = F.element_at(F.array(*[F.lit(w) for _, w in rules]), F.col("rule"))
    return valued.join(best, "_values").select(row_id, skill, "rule", confidence.alias("confidence"))


def context(rows: DataFrame, key: str, lookups: list[tuple[DataFrame, str]]) -> DataFrame:
    """``rows`` with the columns of each lookup, (table, its key); a lookup has a row a key."""
    for other, of in lookups:
        rows = rows.join(other.withColumnRenamed(of, "_key"), F.col(key) == F.col("_key"), "left").drop("_key")
    return rows


def recommended(rows: DataFrame, groups: list[str], key: str, weights: dict[str, float], full_evidence: float, most: int) -> DataFrame:
    """The ``most`` rows of each group of the highest weighted score that have evidence, which counts up to ``full_evidence``."""
    part = {"evidence": F.least(F.col("evidence") / full_evidence, F.lit(1.0))}
    score = reduce(Column.__add__, [F.lit(w) * part.get(c, F.col(c)) for c, w in weights.items()])
    ranked = rows.withColumn("priority", score).withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("priority"), key)))
    return ranked.where((F.col("rank") <= most) & (F.col("evidence") > 0)).select(*groups, key, "evidence", "priority", F.col("rank").cast("long").alias("rank"))


def edges(links: list[tuple[DataFrame, str, str, str, str, str]]) -> DataFrame:
    """Distinct edges (a, b, kind) of (table, kind of a, its column, kind of b, its column, kind of the edge)."""
    node = lambda kind, c: F.concat_ws(":", F.lit(kind), F.col(c).cast("string"))
    return reduce(DataFrame.unionByName, [t.select(node(ka, a).alias("a"), node(kb, b).alias("b"), F.lit(kind).alias("kind")).distinct() for t, ka, a, kb, b, kind in links])


def scoped_or_all(rows: DataFrame, key: str, own: str) -> DataFrame:
    """Rows of which ``own`` holds; all rows of a key of which it holds for none."""
    scoped = rows.where(own).select(key).distinct()
    return rows.where(own).unionByName(rows.join(scoped, key, "left_anti").select(rows.columns))


def any_like(column: Column, patterns: list[str]) -> Column:
    return reduce(Column.__or__, [column.ilike(p) for p in patterns])


def escaped_like(column: Column, text: str) -> Column:
    """Whether the column holds the text, whatever its case; wildcards in the text stand for themselves."""
    for sign in ("\\", "%", "_"):
        text = text.replace(sign, "\\" + sign)
    return column.ilike(f"%{text}%")


def clamped(limit: int, most: int) -> int:
    return min(max(limit, 1), most)
