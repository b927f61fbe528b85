"""Hierarchies against walks by hand."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evidloom.operators import hierarchy


def walked(parent: dict, node):
    path, seen = [node], {node}
    while parent.get(path[-1]) is not None:
        if parent[path[-1]] in seen:
            return None
        path.append(parent[path[-1]])
        seen.add(path[-1])
    return path[::-1]


def test_rooted(spark):
    rng = random.Random(4)
    nodes = list(range(300))
    parent = {i: rng.choice([None, rng.randrange(300), max(0, i - 1)]) for i in nodes}
    parent = {i: p if p != i else None for i, p in parent.items()}
    parent |= {i: i - 1 for i in range(401, 530)} | {400: None}  # a long chain
    parent |= {600: 601, 601: 602, 602: 600, 603: 600, 604: 603}  # a circle, and what leads into it
    rows = [(c, p) for c, p in parent.items() if p is not None] + [(7, 7), (None, 1), (1, None), (5, 99_999)]
    edges = spark.createDataFrame(rows, "child long, parent long")
    got = {r.id: r for r in hierarchy.rooted(spark.createDataFrame([(i,) for i in parent] + [(3,), (None,)], "id long"), edges).collect()}
    assert set(got) == set(parent)
    for i in parent:
        path = walked(parent, i)
        assert (got[i].root, got[i].depth, got[i].path) == ((None, None, None) if path is None else (path[0], len(path) - 1, path)), i
    assert got[529].depth == 129 and got[604].root is None


def test_several_parents_follow_the_least(spark):
    edges = spark.createDataFrame([("c", "b"), ("c", "a"), ("b", "a")], "child string, parent string")
    got = {r.id: r.path for r in hierarchy.rooted(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), edges).collect()}
    assert got == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"]}


def test_closure(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)}
    got = {(r.node, r.ancestor): r.depth for r in hierarchy.closure(spark.createDataFrame([*edges, (1, None), (2, 2), *list(edges)[:5]], "child int, parent int")).collect()}
    up = {}
    for c, p in edges:
        if c != p:
            up.setdefault(c, set()).add(p)
    want = {}
    for c in up:
        level, depth, seen = up[c], 1, {}
        while level - set(seen):
            seen |= dict.fromkeys(level - set(seen), depth)
            level, depth = {q for p in level for q in up.get(p, ())}, depth + 1
        want |= {(c, a): d for a, d in seen.items()}
    assert got == want and any(a == b for a, b in want)
    assert hierarchy.closure(spark.createDataFrame([], "child int, parent int")).count() == 0


def test_edges_by_name_and_level(spark):
    rows = spark.createDataFrame([(1, "u:a", None), (2, "u:b", "u:a"), (3, "u:c", "u:none"), (4, "u:d", "u:d"), (5, None, "u:b"), (6, "u:a", "u:b"), (2, "u:b", "u:a")], "id int, uri string, broader string")
    assert sorted((r.child, r.parent) for r in hierarchy.resolved_edges(rows, "id", "uri", "broader").collect()) == [(2, 1), (5, 2), (6, 2)]
    levels = spark.createDataFrame([("a", "b", ""), ("a", None, "c"), ("a", "", None), (None, None, None), ("a", "a", "")], "x string, y string, z string")
    got = [r.e and tuple(r.e) for r in levels.select(hierarchy.level_edge([F.col("x"), F.col("y"), F.col("z")]).alias("e")).collect()]
    assert got == [("b", "a"), ("c", "a"), None, None, None]
