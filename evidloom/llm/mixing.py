"""Mixing sources to target weights by Pareto order sampling.

A document is due ``target / source size`` copies of itself, times its relative weight where a
weight column is named. The whole part of that is certain; the fractional part is its inclusion
probability p for one more copy. Documents are ranked by q = odds(u) / odds(p), u uniform from a
hash of doc_id and the seed, and those of least q are taken until the words still due are met as
nearly as whole documents allow. So a rerun, in whatever partitioning, takes the same documents.

The rank at which a source is full is found without sorting it: words are summed by source and
one of ``BINS`` ranges of the rank, and only the documents of the range in which the source gets
full are ordered, equal rows as one. Sources are a written table of a row each, which is joined to
the documents; none of it reaches the driver. As long as Spark broadcasts that table, texts are not
shuffled, and one source may hold most of the rows.

Null texts have size 0 and take no words. A null source is a source of its own, after the
others. Repeated rows of one doc_id are ranked by text; equal ones are counted, and as many of them
are taken as find room, whichever these are. A null doc_id counts as less than any other. Texts of any
length and columns of any other names go through; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidloom.llm.scratch import remove, shielded, written

BINS = 4096
MOST = 3


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0))


def cycled_weights(sources: DataFrame, cycle=(1, 2, 3)) -> DataFrame:
    """``sources`` (_source, a row each) with _weight: by code point, null last, the weights of ``cycle`` in turn."""
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("_source"))) - 1  # a row a source
    return sources.withColumn("_weight", F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (place % len(cycle) + 1).cast("int")))


def targets(sources: DataFrame, share: float = 1.0, most: float = MOST) -> DataFrame:
    """``sources`` (_source, source_size, _weight) with target: shares by weight of ``share`` of all sizes, none above ``most`` times its size.

    Sources that reach that bound are those of the least bound a weight. The words that a unit of weight is worth once the
    first of these are full rises as long as the next is full as well, so it is the greatest of what it is worth in turn.
    """
    size, w = F.col("source_size").cast("double"), F.col("_weight")
    before = Window.orderBy(most * size / w, "_source").rowsBetween(Window.unboundedPreceding, -1)  # a row a source
    every = Window.partitionBy()
    all_words, all_weights = F.sum(size).over(every), F.sum(w).over(every)
    unit = (share * all_words - F.coalesce(F.sum(most * size).over(before), F.lit(0.0))) / (all_weights - F.coalesce(F.sum(w).over(before), F.lit(0.0)))
    units = sources.withColumn("_unit", unit)
    return units.withColumn("target", F.least(most * size, w * F.max("_unit").over(every))).drop("_unit")


class Mix:
    def __init__(self, docs: DataFrame, weights=cycled_weights, share: float = 1.0, weight: str | None = None, seed: int = 0, most: float = MOST):
        self.docs, self.weight, self.seed, self.most = docs, weight, seed, most
        thin, path = written(self._facts(docs).select("_id", "_source", "_size", "_w", "_u", "_h"), "sizes")
        sums = thin.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.sum(F.col("_size") * F.col("_w")).alias("_sum"))
        rate = F.when(F.col("_sum") > 0, F.col("target") / F.col("_sum")).otherwise(0.0)
        rates, rates_path = written(targets(weights(sums), share, most).select("_source", "source_size", "target", rate.alias("_rate")), "rates")
        # Equal rows are counted, so that a document of very many rows is one.
        due = self._ranked(thin.groupBy("_id", "_source", "_size", "_w", "_u", "_h").agg(F.count("*").alias("_n")), rates)
        words = F.col("_size") * F.col("_n")
        left = due.groupBy("_source").agg((F.first("target") - F.sum(F.col("_whole") * words)).alias("_left"))
        bins = due.where("_p > 0").groupBy("_source", "_bin").agg(F.sum(words).alias("_words"))
        bins = bins.withColumn("_before", F.sum("_words").over(Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)))
        bins = bins.withColumn("_before", F.coalesce("_before", F.lit(0))).join(left.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
        full = bins.where("_before < _left").groupBy("_source").agg(F.max(F.struct("_bin", "_before", "_left")).alias("x")).select(F.col("_source").alias("_s"), "x.*")
        last = due.where("_p > 0").join(full.withColumnRenamed("_bin", "_last"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_last")))
        before = F.sum(words).over(Window.partitionBy("_source").orderBy("_rank", "_id", "_h").rowsBetween(Window.unboundedPreceding, -1))
        last = last.withColumn("_at", F.col("_before") + F.coalesce(before, F.lit(0)))
        # Of n equal rows those are taken of which at least half still finds room.
        fits = F.when(F.col("_size") > 0, F.floor((F.col("_left") - F.col("_at") - F.col("_size") / 2) / F.col("_size")) + 1).otherwise(F.when(F.col("_at") <= F.col("_left"), F.col("_n")).otherwise(0))
        last = last.withColumn("_fits", F.greatest(F.lit(0), F.least(F.col("_n"), fits)).cast("long")).where("_fits > 0")
        last = last.groupBy("_source").agg(F.max(F.struct("_rank", "_id", "_h", "_fits", "_n")).alias("cut"))
        cuts = full.select("_s", F.col("_bin").alias("_last")).join(last, F.col("_s").eqNullSafe(F.col("_source")), "left").select("_s", "_last", "cut")
        table = rates.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
            "_source", "source_size", "target", "_rate", F.coalesce("_last", F.lit(-1)).alias("_last"), F.when(F.col("cut").isNotNull(), F.struct("cut._rank", "cut._id", "cut._h")).alias("_cut"),
            F.when(F.col("cut._fits") < F.col("cut._n"), F.col("cut._fits")).alias("_some"),
        )
        self.table, _ = written(table, "mix")
        self.split = not self.table.where("_some IS NOT NULL").isEmpty()  # whether some source takes a part of equal rows
        remove(docs.sparkSession, path, rates_path)

    def _facts(self, docs: DataFrame) -> DataFrame:
        u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(self.seed))).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
        return docs.withColumns({
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_source": F.col("source").cast("string"), "_size": word_count("text"),
            "_w": F.greatest(F.coalesce(F.col(self.weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if self.weight else F.lit(1.0), "_u": u, "_h": F.md5(F.coalesce("text", F.lit("")).cast("binary")),
        })

    def _ranked(self, facts: DataFrame, table: DataFrame) -> DataFrame:
        """Adds the certain copies, the probability of one more, and the rank for it."""
        t = table.withColumnRenamed("_source", "_s")
        out = facts.join(t, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
        out = out.withColumn("_due", F.least(F.col("_w") * F.col("_rate"), F.lit(float(self.most))))
        out = out.withColumn("_whole", F.floor("_due")).withColumn("_p", F.col("_due") - F.col("_whole"))
        odds = F.col("_u") * (1 - F.col("_p"))
        out = out.withColumn("_rank", odds / (odds + (1 - F.col("_u")) * F.col("_p")))
        return out.withColumn("_bin", F.floor(F.col("_rank") * BINS).cast("int"))

    def rows(self) -> DataFrame:
        """``docs`` with mix_size, source_size, target and copies."""
        out = self._ranked(self._facts(self.docs), self.table)
        at = F.struct("_rank", "_id", "_h")
        inside = (F.col("_p") > 0) & ((F.col("_bin") < F.col("_last")) | ((F.col("_bin") == F.col("_last")) & F.coalesce(at <= F.col("_cut"), F.lit(False))))
        told = lambda rows, more: rows.withColumn("copies", F.col("_whole") + F.when(more, 1).otherwise(0)).select(*[f"`{c}`" for c in self.docs.columns], F.col("_size").alias("mix_size"), "source_size", "target", "copies")
        if not self.split:
            return told(out, inside)
        # Equal rows of which some are taken: numbered by the task that read them, and by those before it.
        tie = F.coalesce(F.col("_some").isNotNull() & (F.col("_p") > 0) & (at == F.col("_cut")), F.lit(False))
        equal, _ = written(out.where(tie).withColumn("_part", F.spark_partition_id()), "equal")
        counts = equal.groupBy("_source", "_part").agg(F.count("*").alias("_rows"))
        starts = counts.select(F.col("_source").alias("_s"), F.col("_part").alias("_q"), F.coalesce(F.sum("_rows").over(Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
        number = F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_id")) + F.col("_start")
        numbered = equal.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_q"))).withColumn("_number", number)
        return told(out.where(~tie), inside).unionByName(told(numbered, F.col("_number") <= F.col("_some")))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source)."""
    names = [c for c in ("doc_id", "text", "source", how.get("weight")) if c]
    out = Mix(docs.select(*names), **how).rows()
    return out.select("doc_id", F.col("mix_size").alias("size"), "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("mix_size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken."""
    rows, back = shielded(docs, "doc_id", "text", "source", how.get("weight") or "doc_id")
    out = Mix(rows, **how).rows().where("copies > 0")
    return back(out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
