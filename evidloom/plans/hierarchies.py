"""Hierarchies: parts by size, customers' referrals, turns of conversations, levels of pages."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from evidloom.operators import hierarchy
from evidloom.plans.registry import query, table

_DOWN = "t AS (SELECT id, id AS root, 0 AS depth, id::VARCHAR AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.id, t.root, t.depth + 1, t.path || '/' || e.id FROM t JOIN e ON e.parent = t.id)"
_PARTS = "e AS (SELECT p_partkey AS id, CASE WHEN p_partkey // p_size <> p_partkey AND p_partkey // p_size IN (SELECT p_partkey FROM part) THEN p_partkey // p_size END AS parent FROM part)"
_REFERRALS = "e AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'BUILDING' AND p <> c_custkey AND p IN (SELECT c_custkey FROM customer) THEN p END AS parent FROM (SELECT *, (c_custkey * 31 + c_nationkey) % (SELECT count(*) FROM customer) AS p FROM customer))"


def _part_edges(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.expr("p_partkey div p_size").alias("of"))
    return p, hierarchy.resolved_edges(p, "p_partkey", "p_partkey", "of")


@query("part_tree", f"WITH RECURSIVE {_PARTS}, {_DOWN} SELECT id AS p_partkey, root, depth::INT AS depth, path FROM t")
def part_tree(spark, sf):
    """Each part under the part that its key divided by its size names: root, depth and path."""
    p, edges = _part_edges(spark, sf)
    out = hierarchy.rooted(p.select(F.col("p_partkey").alias("id")), edges)
    return out.select(F.col("id").alias("p_partkey"), "root", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query("part_descendants", f"WITH RECURSIVE {_PARTS}, c AS (SELECT id, parent AS ancestor, 1 AS depth FROM e WHERE parent IS NOT NULL UNION ALL SELECT c.id, e.parent, c.depth + 1 FROM c JOIN e ON e.id = c.ancestor WHERE e.parent IS NOT NULL) SELECT ancestor, count(*) AS descendants, max(depth)::INT AS deepest FROM c GROUP BY 1")
def part_descendants(spark, sf):
    _, edges = _part_edges(spark, sf)
    return hierarchy.closure(edges).groupBy("ancestor").agg(F.count("*").alias("descendants"), F.max("depth").alias("deepest"))


@query("referral_roots", f"WITH RECURSIVE {_REFERRALS}, {_DOWN} SELECT e.id AS c_custkey, t.root, t.depth::INT AS depth, t.id IS NULL AS circular FROM e LEFT JOIN t ON t.id = e.id")
def referral_roots(spark, sf):
    """Who stands at the start of each customer's chain of referrals; chains that go round in a circle have no start."""
    c = table(spark, sf, "customer")
    total = c.agg(F.count("*").alias("n"))
    rows = c.join(F.broadcast(total)).select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.pmod(F.col("c_custkey") * 31 + F.col("c_nationkey"), F.col("n"))).alias("by"))
    out = hierarchy.rooted(rows.select(F.col("c_custkey").alias("id")), hierarchy.resolved_edges(rows, "c_custkey", "c_custkey", "by"))
    return out.select(F.col("id").alias("c_custkey"), "root", "depth", F.col("root").isNull().alias("circular"))


@query("turn_ancestors", """WITH RECURSIVE e AS (SELECT conv_id, turn, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.role <> a.role) AS parent FROM conversations a),
c AS (SELECT conv_id, turn, parent, 1 AS depth FROM e WHERE parent IS NOT NULL UNION ALL SELECT c.conv_id, c.turn, e.parent, c.depth + 1 FROM c JOIN e ON e.conv_id = c.conv_id AND e.turn = c.parent WHERE e.parent IS NOT NULL) SELECT conv_id, count(*) AS pairs, max(depth)::INT AS deepest FROM c GROUP BY 1""")
def turn_ancestors(spark, sf):
    """Each turn answers the last one of another role before it; all that it builds on, a conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before, role = F.lag("turn").over(w), F.lag("role").over(w)
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.when(role != F.col("role"), before).alias("new"))
    t = t.withColumn("parent", F.last("new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edges = t.where("parent IS NOT NULL").select(F.struct("conv_id", "turn").alias("child"), F.struct("conv_id", F.col("parent").alias("turn")).alias("parent"))
    return hierarchy.closure(edges).groupBy("node.conv_id").agg(F.count("*").alias("pairs"), F.max("depth").alias("deepest"))


@query("page_levels", r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages WHERE url IS NOT NULL),
l AS (SELECT list_filter([host, CASE WHEN len(s) >= 1 THEN host || '/' || s[1] END, CASE WHEN len(s) >= 2 THEN host || '/' || s[1] || '/' || s[2] END], lambda x: x IS NOT NULL AND x <> '') AS l FROM p) SELECT l[len(l)] AS child, l[len(l) - 1] AS parent, count(*) AS pages FROM l WHERE len(l) >= 2 GROUP BY 1, 2""")
def page_levels(spark, sf):
    """Last and second-last level of each page's address."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    parts = F.filter(F.split(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")
    p = table(spark, sf, "pages").where("url IS NOT NULL").select(host.alias("host"), parts.alias("s"))
    level = lambda k: F.when(F.size("s") >= k, F.concat_ws("/", "host", F.slice("s", 1, k)))
    return p.select(hierarchy.level_edge([F.col("host"), level(1), level(2)]).alias("e")).where("e IS NOT NULL").groupBy("e.child", "e.parent").agg(F.count("*").alias("pages"))
