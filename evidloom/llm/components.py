"""Connected components by alternating star contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from evidloom.llm.scratch import remove, written


def _counted(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """Writes edges; their number and a checksum, observed as they are written, tell whether they changed."""
    seen = Observation()
    edges, path = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return edges, path, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge; component is the least node that links reach.

    Nodes are of any orderable type. Each round joins every node to the least of its neighbours
    (first over all edges, then over those to lesser nodes). Counts are pre-aggregated and the
    joins are on single keys, so a node with very many links is dealt out by skewed-join
    splitting. Null ends and loops are dropped; repeated edges count once.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e, path, now = _counted(e)
    before = None
    for _ in range(rounds):
        if before == now or not now[0]:
            break
        before = now
        # Large star: greater neighbours of u move to the least of u and its neighbours.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")  # at most a row an edge; made distinct below
        large, p1 = written(large, "large")
        # Small star: lesser neighbours of u, and u, move to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        e, p2, now = _counted(moved.where("u <> v").distinct())
        remove(spark, p1, path)
        path = p2
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
