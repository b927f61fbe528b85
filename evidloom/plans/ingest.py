"""JSON, HTML, reshaping and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.functions import dates, numbers
from evidloom.operators import quality
from evidloom.plans.registry import query, table
from evidloom.sources import files
from evidloom.streaming import silence, windows
from evidloom.tables import new_folder


@query("json_predicate", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE coalesce(json_extract_string(props, '$.k'), '') <> '') AS with_k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1")
def json_predicate(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.coalesce(k, F.lit("")) != "").alias("with_k"), F.max(k.cast("long")).alias("most"))


@query("json_fields", "SELECT k AS field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) GROUP BY 1")
def json_fields(spark, sf):
    return table(spark, sf, "events").select(F.explode(F.json_object_keys("props")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@query("unpivoted", "SELECT o_orderkey, l_linenumber, indicator, value FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR indicator IN (quantity, discount, tax))")
def unpivoted(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return d.unpivot(["o_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "indicator", "value")


@query("page_links", """SELECT page_id, count(*) AS links, count(DISTINCT l) AS distinct_links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS l FROM pages) GROUP BY 1""")
def page_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(files.links(F.col("html"))).alias("l")).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("l").alias("distinct_links"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))


@query("visible_text", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2(files.visible_text(F.col("html")), 256).alias("digest"))


@query("event_quarters", "SELECT year(ts)::INT AS year, 'Q' || quarter(ts) AS quarter, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def event_quarters(spark, sf):
    return table(spark, sf, "events").groupBy(F.year("ts").alias("year"), dates.quarter(F.col("ts")).alias("quarter"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("parsed_numbers", "SELECT s_suppkey, round(s_acctbal, 2) AS value FROM supplier")
def parsed_numbers(spark, sf):
    """Amounts written with thousands signs and negative ones in parentheses, read back."""
    shown = F.when(F.col("s_acctbal") < 0, F.concat(F.lit("("), F.format_number(F.abs("s_acctbal"), 2), F.lit(")"))).otherwise(F.format_number("s_acctbal", 2))
    return table(spark, sf, "supplier").select("s_suppkey", numbers.parse_number(shown).alias("value"))


@query("conversation_carry", "SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations")
def conversation_carry(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("last_user"))


@query("nested_merge", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, count(*) AS n FROM events GROUP BY 1")
def nested_merge(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.count("*").alias("n"))


@query("latency_summary", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_summary(spark, sf):
    e = table(spark, sf, "events").where("value IS NOT NULL")
    some = e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return some.join(quality.nearest_rank(e, "event_type", "value", 0.95).withColumnRenamed("value", "p95"), "event_type")


def _events(spark, sf):
    return windows.events(spark, f"{sf}/events.parquet*")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    out = windows.drained(_events(spark, sf), windows.tumbling)
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("stream_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([b, b - INTERVAL 6 HOUR, b - INTERVAL 12 HOUR, b - INTERVAL 18 HOUR]) AS s FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM events)) GROUP BY 1, 2")
def stream_sliding(spark, sf):
    out = windows.drained(_events(spark, sf), windows.sliding)
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@query("stream_sessions", """WITH o AS (SELECT user_id, ts, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE AS new FROM events), s AS (SELECT user_id, ts, sum(coalesce(new, true)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    out = windows.drained(_events(spark, sf), windows.sessions)
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


#: Events as four deliveries; some of each come again with the next.
_DELIVERED = "a AS (SELECT *, event_id % 4 AS b FROM events UNION ALL SELECT *, event_id % 4 + 1 FROM events WHERE event_id % 11 = 0 AND event_id % 4 < 3), m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM a GROUP BY b), x AS (SELECT a.*, coalesce(ts <= latest - INTERVAL 1 DAY, false) AS late FROM a JOIN m USING (b))"


def _delivered(spark, sf):
    """Takes the deliveries in one by one; gives what took them, and the counts of the rows in time, each once."""
    path = new_folder(spark, "deliveries")
    e, take, counts = table(spark, sf, "events"), None, None
    for k in range(4):
        e.where((F.col("event_id") % 4 == k) | ((F.col("event_id") % 11 == 0) & (F.col("event_id") % 4 == k - 1))).write.mode("append").parquet(path)
        take = take or windows.Arrivals(windows.events(spark, path))
        take.run()
        counts = counts or windows.Appended(take.in_time(), lambda s: windows.tumbling(windows.deduplicated(s)))
        counts.run()
    return take, counts


@query("stream_late", f"WITH {_DELIVERED} SELECT event_id, b::INT AS batch FROM x WHERE late")
def stream_late(spark, sf):
    """Events that came after the watermark had passed them, and with which delivery."""
    return _delivered(spark, sf)[0].late_rows().select("event_id", "batch")


@query("stream_exact_counts", f"WITH {_DELIVERED} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT DISTINCT event_id, ts, event_type, value FROM x WHERE NOT late) GROUP BY 1, 2")
def stream_exact_counts(spark, sf):
    return _delivered(spark, sf)[1].close().select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("stream_silences", """WITH o AS (SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM events WHERE user_id IS NOT NULL)
SELECT user_id, 'stale' AS state, make_timestamp(t + 86400000000) AS at FROM o WHERE following IS NULL OR following - t > 86400000000 UNION ALL SELECT user_id, 'recovered', make_timestamp(following) FROM o WHERE following - t > 86400000000""")
def stream_silences(spark, sf):
    """Users who were silent for a day, marked once by a timer, and when they came back."""
    with silence.rocksdb(spark):
        return windows.drained(_events(spark, sf), lambda s: silence.silences(s, "user_id", silence_minutes=24 * 60))
