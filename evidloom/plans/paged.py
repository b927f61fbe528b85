"""Pages read as an answer in numbered or chained parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.plans.registry import query, table
from evidloom.sources.paged import PagedSource
from evidloom.streaming.windows import drained_rows
from evidloom.tables import new_folder

SCHEMA = "page_id long, url string, html string"
_PAGES = "SELECT page_id, url, length(html) AS chars FROM pages"


def _split(spark, sf):
    """The table as numbered answers of twenty records, each of which names the next."""
    p = table(spark, sf, "pages").withColumn("page", F.expr("page_id div 20"))
    each = p.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("page_id", "url", "html"))).alias("results"))
    there = each.select((F.col("page") - 1).alias("page"), F.col("page").alias("next"))
    answers = each.join(there, "page", "left").select("page", F.to_json(F.struct(F.struct("results").alias("answer"), "next")).alias("value"))
    path = new_folder(spark, "answers")
    answers.write.partitionBy("page").text(path)
    spark.dataSource.register(PagedSource)
    return path


def _sized(df):
    return df.select("page_id", "url", F.length("html").cast("long").alias("chars"))


@query("paged_records", _PAGES)
def paged_records(spark, sf):
    """All numbered pages, some to a task."""
    return _sized(spark.read.format("paged").schema(SCHEMA).option("dataPath", "answer.results").load(_split(spark, sf)))


@query("cursor_records", f"{_PAGES} WHERE page_id < 100")
def cursor_records(spark, sf):
    """The first five pages of a chain."""
    return _sized(spark.read.format("paged").schema(SCHEMA).options(dataPath="answer.results", mode="cursor", most=5).load(_split(spark, sf)))


@query("stream_records", _PAGES)
def stream_records(spark, sf):
    """The same pages as a stream."""
    stream = spark.readStream.format("paged").schema(SCHEMA).option("dataPath", "answer.results").load(_split(spark, sf))
    return _sized(drained_rows(stream))
