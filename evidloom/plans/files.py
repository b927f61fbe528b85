"""The given tables written as files of other kinds, and read again by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions import dates
from evidloom.plans.registry import query, table
from evidloom.sources import files
from evidloom.tables import new_folder


def _csv(spark, rows, separator=",", name="csv"):
    path = new_folder(spark, name)
    rows.write.option("header", True).option("sep", separator).option("escape", '"').csv(path)
    return path


@query("csv_records", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_records(spark, sf):
    """Orders through a folder of CSV files."""
    path = _csv(spark, table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    return files.read_csv(spark, path).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")


@query("multi_line_records", r"SELECT conv_id, turn, md5(text) AS digest FROM conversations")
def multi_line_records(spark, sf):
    """Texts with line ends, quotes and separators through CSV."""
    path = _csv(spark, table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return files.read_csv(spark, path, multi_line=True).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.md5("text").alias("digest"))


@query("delimited_records", "SELECT p_partkey, p_name, p_size FROM part")
def delimited_records(spark, sf):
    """Parts through files whose separator is found out."""
    path = _csv(spark, table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "|")
    return files.read_delimited(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"))


@query("numbered_lanes", "SELECT CASE WHEN o_totalprice >= 200000 THEN 'bad' ELSE 'good' END AS lane, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def numbered_lanes(spark, sf):
    """Rows of CSV files in two lanes: those of the schema, and the text of those that are not (here, prices with a unit)."""
    price = F.when(F.col("o_totalprice") >= 200_000, F.concat(F.col("o_totalprice").cast("string"), F.lit(" EUR"))).otherwise(F.col("o_totalprice").cast("string"))
    path = _csv(spark, table(spark, sf, "orders").select("o_orderkey", price.alias("o_totalprice")))
    good, bad = files.read_csv_rows(spark, path, "o_orderkey long, o_totalprice double")
    lost = F.regexp_extract("line", r"^(\d+),", 1).cast("long")
    both = good.select(F.lit("good").alias("lane"), "o_orderkey", "_row").unionByName(bad.select(F.lit("bad").alias("lane"), lost.alias("o_orderkey"), "_row"))
    return both.groupBy("lane").agg(F.count_distinct("_row").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("imported_events", "SELECT event_id, event_type FROM events")
def imported_events(spark, sf):
    """Events delivered twice, in several folders' files, and imported once each."""
    path, to = _csv(spark, table(spark, sf, "events").select("event_id", "event_type")), new_folder(spark, "imported")
    files.import_csv(spark, path, "event_id long, event_type string", to, f"{to}-state", "event_id", files_a_batch=50)
    table(spark, sf, "events").select("event_id", "event_type").write.mode("append").option("header", True).csv(path)
    files.import_csv(spark, path, "event_id long, event_type string", to, f"{to}-state", "event_id", files_a_batch=50)
    return spark.read.parquet(to).select("event_id", "event_type")


@query("json_records", "SELECT event_id, user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_records(spark, sf):
    """Events through JSON lines."""
    path = new_folder(spark, "json")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", F.from_json("props", "k long").alias("props")).write.json(path)
    return files.read_json_lines(spark, path, "event_id long, user_id long, event_type string, props struct<k:long>").select("event_id", "user_id", "event_type", "props.k")


@query("json_documents", "SELECT conv_id, turn, role FROM conversations")
def json_documents(spark, sf):
    """Conversations, a hundred a document, which holds their turns in a field."""
    path = new_folder(spark, "documents")
    turns = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("conv_id", "turn", "role"))).alias("records"))).alias("value")
    some = table(spark, sf, "conversations").withColumn("part", F.expr("conv_id div 100")).groupBy("part").agg(turns)  # a hundred conversations a document
    some.write.partitionBy("part").text(path)
    return files.read_json(spark, path, "conv_id long, turn long, role string").select("conv_id", "turn", "role")


@query("routed_tables", "SELECT 'orders' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'customers', count(*) FROM customer")
def routed_tables(spark, sf):
    """Which kind of file each table is, by the columns that it has, and its rows."""
    signatures = {"orders": {"o_orderkey", "o_totalprice"}, "parts": {"p_partkey", "p_name"}, "customers": {"c_custkey"}}
    out = None
    for name in ("orders", "part", "customer"):
        t = table(spark, sf, name)
        own = t.agg(F.lit(files.route(t.columns, signatures)).alias("kind"), F.count("*").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query("waiting_seconds", "WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, count(before) AS gaps, round(sum(greatest(0, epoch_us(ts) - epoch_us(before)) / 1e6::DOUBLE), 2) AS seconds FROM o GROUP BY 1")
def waiting_seconds(spark, sf):
    """Seconds between a user's events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    o = table(spark, sf, "events").select("user_id", "ts", F.lag("ts").over(w).alias("before"))
    return o.groupBy("user_id").agg(F.count("before").alias("gaps"), F.round(F.sum(dates.seconds_between(F.col("before"), F.col("ts"))), 2).alias("seconds"))
