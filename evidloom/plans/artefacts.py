"""Evaluation artefacts and bundles with manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.operators import evaluation
from evidloom.plans.quality import _PRED, _predicted
from evidloom.plans.registry import query, table
from evidloom.sources import artefacts
from evidloom.tables import new_folder


@query("evaluation_artefacts", f"""WITH {_PRED}, g AS (SELECT count(DISTINCT o_custkey) AS n FROM orders) SELECT 'predictions' AS artefact, 'doc_id,actual,probability,predicted,correct' AS columns, (SELECT count(*) FROM p) AS rows, 'ok' AS state UNION ALL SELECT 'split_membership', 'o_custkey,number,split', (SELECT n FROM g), 'ok'
UNION ALL SELECT 'metrics', 'n,ece,mce,brier,status', 1, 'ok'""")
def evaluation_artefacts(spark, sf):
    """Predictions, split membership and metrics of an evaluation, written with hashes and checked as they lie there."""
    p = _predicted(spark, sf)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    split = evaluation.group_folds(table(spark, sf, "orders"), "o_custkey", "o_orderdate").select("o_custkey", "number", "split")
    told = {"predictions": p.select("doc_id", F.col("quality").alias("actual"), F.col("score").alias("probability"), predicted.alias("predicted"), (predicted == F.col("quality")).alias("correct")), "split_membership": split, "metrics": evaluation.calibration_summary(p, "quality", "score")}
    folder = new_folder(spark, "evaluation")
    manifest = artefacts.write_artefacts(told, folder)
    states = artefacts.checked_artefacts(spark, folder).groupBy("artefact").agg(F.max("state").alias("state"), F.count_distinct("state").alias("_n"))
    return manifest.select("artefact", "columns", "rows").distinct().join(states, "artefact").select("artefact", "columns", "rows", F.when(F.col("_n") == 1, F.col("state")).otherwise("mixed").alias("state"))


@query("bundle_phases", """WITH c AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT 1 AS phase, 'region' AS artefact, count(*) AS received, count(*) AS kept FROM region UNION ALL SELECT 2, 'nation', count(*), count(*) FROM nation UNION ALL SELECT 3, 'customer', count(*), count(*) FROM c
UNION ALL SELECT 4, 'orders', count(*), count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM c)) FROM orders""")
def bundle_phases(spark, sf):
    """Regions, nations, customers (but one segment) and orders as a bundle, imported in phases: a row whose parent was not imported is left out."""
    held = {"region": table(spark, sf, "region").select("r_regionkey", "r_name"), "nation": table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "customer": table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_nationkey"), "orders": table(spark, sf, "orders").select("o_orderkey", "o_custkey")}
    folder = new_folder(spark, "bundle")
    artefacts.write_artefacts(held, folder)
    under = lambda parent, key, own: lambda done, rows: rows.join(done[parent].select(F.col(key).alias(own)), own, "left_semi")
    schema = lambda name: ", ".join(f"{c} {k}" for c, k in held[name].dtypes)
    phases = [("region", schema("region"), lambda _, rows: rows), ("nation", schema("nation"), under("region", "r_regionkey", "n_regionkey")), ("customer", schema("customer"), under("nation", "n_nationkey", "c_nationkey")), ("orders", schema("orders"), under("customer", "c_custkey", "o_custkey"))]
    return artefacts.import_bundle(spark, folder, phases)[1]
