"""The fold of decisions against a walk by hand, over ranges that begin inside keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from evidloom.operators import reviews


def walked(rows):
    state, out = {}, {}
    for key, at, decision, note in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        now = state.get(key, "pending")
        decision = decision and decision.strip().lower()
        to = reviews.MAPPING.moves.get((now, decision))
        if len(note or "") < 10:
            to, why = None, "short"
        elif decision not in reviews.MAPPING_STATUS:
            why = f"unsupported decision {decision if decision is not None else 'null'}"
        else:
            why = None if to else f"{decision} is not allowed from {now}"
        state[key] = to or now
        out[key, at] = (now, decision, to or now, to is not None, why)
    return out


def test_log_over_many_ranges(spark):
    rng = random.Random(3)
    kinds = [*reviews.MAPPING_STATUS, " Approved ", "nonsense", None]
    weights = [4, 4, 0.02, 6, 2, 3, 3, 1, 1, 1]
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, rng.choices(kinds, weights)[0], rng.choice(["long enough note"] * 5 + ["short", None])) for i in range(2000)]
    rows += [(k, 5000, "approved", "long enough note") for k in range(10, 40)]
    log = spark.createDataFrame(rows, "k long, at long, what string, note string").selectExpr("*", "'x' AS status0", "1 AS _first0").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = reviews.reviewed(log, "k", ["at"], F.col("what"), reviews.MAPPING, [("short", "length(note) >= 10")])
        got = {(r.k, r.at): (r.previous, r.decision, r.status, r.accepted, r.reason) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == walked(rows)
    assert len({x[4] for x in got.values()}) > 6
    assert reviews.reviewed(log.where("false"), "k", ["at"], F.col("what"), reviews.MAPPING).count() == 0
    last = {r.k: (r.status, r.decided + r.refused) for r in reviews.final_states(out, "k", ["at"]).collect()}
    assert last[1][0] == got[1, max(at for k, at, *_ in rows if k == 1)][2] and sum(n for _, n in last.values()) == len(rows)


def test_merged_is_final():
    assert not [d for s, d in reviews.MAPPING.moves if s == "merged"]
    assert reviews.MAPPING.moves["needs_review", "resolved"] == "approved" and ("pending", "resolved") not in reviews.MAPPING.moves
