"""Hierarchies from parent references: resolved edges, roots with paths, and all ancestors, by doubling.

Each round joins what is known of a node with what is known of where that leads, so a chain of n nodes
takes log n rounds. Rounds are written tables, which cut lineage; only nodes not settled yet are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidloom.tables import dropped, stored


def resolved_edges(rows: DataFrame, id_col: str, name_col: str, parent_name_col: str) -> DataFrame:
    """(child, parent): ids of rows and of the row that their parent's name names; of several such rows the least.

    Names that no row has, null names, and rows that name themselves give no edge.
    """
    named = rows.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("_name")).agg(F.min(id_col).alias("parent"))
    own = rows.select(F.col(id_col).alias("child"), F.col(parent_name_col).alias("_name")).where("child IS NOT NULL")
    return own.join(named, "_name").where("child <> parent").select("child", "parent").distinct()


def level_edge(levels: list[Column]) -> Column:
    """{child, parent}: the last and second-last of levels that are neither null nor empty; null where there are fewer than two."""
    held = F.filter(F.array(*levels), lambda x: x.isNotNull() & (x != ""))
    edge = F.struct(F.element_at(held, -1).alias("child"), F.try_element_at(held, F.lit(-2)).alias("parent"))
    return F.when((F.size(held) >= 2) & (edge["child"] != edge["parent"]), edge)


def rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root, depth, path) of each node (``nodes``: id) under the edges (child, parent); path goes from the root down to the node.

    A node with several parents follows the least. Nodes whose parents lead round in a circle have null root,
    depth and path. Parents that are no nodes are not followed.
    """
    spark = nodes.sparkSession
    ids = nodes.select("id").where("id IS NOT NULL").distinct()
    up = edges.where("child <> parent").join(ids.select(F.col("id").alias("parent")), "parent").groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("up"))
    kind = f"array<{ids.schema['id'].dataType.simpleString()}>"
    first = ids.join(up, "id", "left").select(
        "id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), F.array()).otherwise(F.array("id")).cast(kind).alias("path"),
        F.col("up").isNull().alias("done"), F.lit(False).alias("round"),
    )
    state, path = stored(first, "hierarchy")
    settled, paths = [state.where("done")], [path]
    open_, known = state.where("NOT done"), state
    while not open_.isEmpty():
        on = known.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("done").alias("_done"), F.col("round").alias("_round"))
        whole = F.concat("_path", "path")
        # A place that comes again, or that is known to be on the way into a circle.
        again = F.col("_round") | (F.size(F.array_distinct(whole)) < F.size(whole)) | (~F.col("_done") & F.array_contains(whole, F.col("_up")))
        step = open_.join(on, "up").select("id", F.col("_up").alias("up"), F.when(again, F.array().cast(kind)).otherwise(whole).alias("path"), (F.col("_done") | again).alias("done"), again.alias("round"))
        state, path = stored(step, "hierarchy")
        paths.append(path)
        settled.append(state.where("done"))
        open_ = state.where("NOT done")
        known = open_
        for s in settled:
            known = known.unionByName(s)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    out, _ = stored(out.select("id", F.when(~F.col("round"), F.col("up")).alias("root"), F.when(~F.col("round"), F.size("path")).alias("depth"), F.when(~F.col("round"), F.concat(F.array("up"), "path")).alias("path")), "rooted")
    dropped(spark, *paths)
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): each ancestor of each child, over any of its parents, at the least distance; a node on a circle is its own ancestor.

    Edges are distinct pairs (child, parent); loops and nulls are left out. The result has a row for every
    ancestor, so it is for hierarchies of small depth.
    """
    spark = edges.sparkSession
    known, path = stored(edges.where("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct(), "closure")
    before, now = None, known.agg(F.count("*"), F.sum("depth")).first()
    while now != before and now[0]:
        on = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_a"), F.col("depth").alias("_d"))
        longer = known.join(on, "ancestor").select("node", F.col("_a").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth"))
        known, new = stored(known.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "closure")
        dropped(spark, path)
        path, before, now = new, now, known.agg(F.count("*"), F.sum("depth")).first()
    return known
