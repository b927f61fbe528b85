"""Quality of sources, changes of tables, reviews, and rows given as maps or JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def completeness(rows: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """Shares of rows of each key that have each part, and the mean share."""
    out = rows.groupBy(key).agg(*[(F.count_if(c).cast("double") / F.count("*")).alias(n) for n, c in parts.items()], F.count("*").alias("n"))
    return out.withColumn("quality", reduce(Column.__add__, [F.col(n) for n in parts]) / len(parts))


def drift(rows: DataFrame, key: str, observed: str, expected: list[str], watch: float = 0.05, changed: float = 0.2) -> DataFrame:
    """Fields missing from and not expected in the rows of each key, and their share of what could be."""
    want = F.array(*[F.lit(e) for e in expected])
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.size(F.array_except(want, observed)).cast("long")).alias("missing"), F.sum(F.size(F.array_except(observed, want)).cast("long")).alias("unexpected"))
    out = out.withColumn("score", (F.col("missing") + F.col("unexpected")).cast("double") / (F.col("n") * len(expected)))
    return out.withColumn("status", F.when(F.col("score") < watch, "stable").when(F.col("score") < changed, "watch").otherwise("changed"))


def compared(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Counts of each key in two versions, and their difference."""
    a, b = (d.groupBy(F.col(key).alias("key")).agg(F.count("*").alias(n)) for d, n in ((old, "old"), (new, "new")))
    return a.join(b, "key", "full").fillna(0, ["old", "new"]).withColumn("delta", F.col("new") - F.col("old"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    gone, come = before.join(after, key, "left_anti"), after.join(before, key, "left_anti")
    return gone.select(key, F.lit("removed").alias("change")).unionByName(come.select(key, F.lit("added").alias("change")))


def to_write(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, action) of rows that are new or of another content."""
    was = old.select(F.col(key).alias("_k"), F.col(content).alias("_c"))
    out = new.join(was, F.col(key) == F.col("_k"), "left").where(~F.col(content).eqNullSafe(F.col("_c")))
    return out.select(key, F.when(F.col("_k").isNull(), "insert").otherwise("update").alias("action"))


def repointed(rows: DataFrame, remap: DataFrame, key: str) -> DataFrame:
    """``rows`` with keys that ``remap`` (id, target) has changed to their targets."""
    return rows.join(remap, F.col(key) == F.col("id"), "left").withColumn(key, F.coalesce("target", key)).drop("id", "target")


def adjudicated(votes: DataFrame) -> DataFrame:
    """State and final label of each task by its (task, reviewer, label, at), of which each reviewer's first counts."""
    own = votes.groupBy("task", "reviewer").agg(F.min_by("label", "at").alias("label"), F.min("at").alias("at"))
    nth = own.withColumn("n", F.row_number().over(Window.partitionBy("task").orderBy("at"))).where("n <= 3")
    of = lambda k: F.max(F.when(F.col("n") == k, F.col("label")))
    out = nth.groupBy("task").agg(of(1).alias("first_label"), of(2).alias("second_label"), of(3).alias("third"))
    same = F.col("first_label") == F.col("second_label")
    state = F.when(F.col("second_label").isNull(), "first_done").when(same, "complete").when(F.col("third").isNull(), "needs_adjudication").otherwise("adjudicated")
    return out.withColumn("state", state).withColumn("final", F.when(same, F.col("first_label")).when(F.col("second_label").isNotNull(), F.col("third"))).drop("third")


def dossier(rows: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """The stages of a record, columns of times of which some are null, as one text in order."""
    steps = F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.concat_ws("@", F.lit(s), F.date_format(s, "yyyy-MM-dd"))) for s in stages]))
    return rows.select(key, F.size(steps).cast("long").alias("stages"), F.array_join(steps, " > ").alias("dossier"))


def numeric_and_text(row: Column) -> tuple[Column, Column]:
    """The cells of a map that are numbers, as such, and the others."""
    number = lambda v: v.try_cast("double")
    return F.transform_values(F.map_filter(row, lambda _, v: number(v).isNotNull()), lambda _, v: number(v)), F.map_filter(row, lambda _, v: number(v).isNull())


def merged_maps(a: Column, b: Column) -> Column:
    """The members of both; those of ``b`` win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def coverage(reach: DataFrame, every: DataFrame, key: str, module: str, most: int) -> DataFrame:
    """How many modules each key reaches, and the share of all, for the ``most`` keys that reach most."""
    total = every.agg(F.count_distinct(module).alias("_all"))
    out = reach.groupBy(key).agg(F.count_distinct(module).alias("reached")).join(F.broadcast(total))
    return out.select(key, "reached", (F.lit(100.0) * F.col("reached") / F.col("_all")).alias("coverage")).orderBy(F.desc("reached"), key).limit(most)


def longest_prefix(codes: DataFrame, code: str) -> DataFrame:
    """The longest other code with which each code begins (null where none does): an equi-join on its proper prefixes."""
    n = F.length(code)
    prefixes = codes.where(n > 1).select(code, F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.left(F.col(code), k))).alias("parent"))
    found = prefixes.join(codes.select(F.col(code).alias("parent")), "parent").groupBy(code).agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return codes.join(found, code, "left")


def imported(old: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``old`` (key, id) after an upsert of ``rows``, with what became of each."""
    a, b = old.withColumnRenamed("id", "_old"), rows.withColumnRenamed("id", "_new")
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").otherwise("updated")
    return a.join(b, key, "full").select(key, F.coalesce("_new", "_old").alias("id"), action.alias("action"))


def for_tenant(rows: DataFrame, tenant: str, name: str) -> DataFrame:
    return rows.where((F.col(tenant) == name) | F.col(tenant).isNull())
