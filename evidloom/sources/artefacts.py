"""Sets of files that must stay as they were written: artefacts of an evaluation with their hashes, and bundles imported in phases.

Hashes are taken of each file where it lies, by the tasks that read it; manifests have a row a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, bytes) of the data files below a folder; ``file`` is the path from the folder on. Files are read whole, one at a time a task."""
    end = folder.rstrip("/").rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*part-*").load(folder)
    return files.select(F.substring_index("path", f"/{end}/", -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_artefacts(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table as CSV with a header, then a manifest (artefact, file, sha256, bytes, rows, columns) beside them, and returns it."""
    spark = next(iter(tables.values())).sparkSession
    told = None
    for name, rows in tables.items():
        rows.write.option("header", True).option("escape", '"').csv(f"{folder}/data/{name}")
        back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/data/{name}")
        own = back.agg(F.count("*").alias("rows")).select(F.lit(name).alias("artefact"), "rows", F.lit(",".join(rows.columns)).alias("columns"))
        told = own if told is None else told.unionByName(own)
    hashes = file_hashes(spark, f"{folder}/data").withColumn("artefact", F.substring_index("file", "/", 1))
    hashes.join(F.broadcast(told), "artefact", "right").write.json(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("artefact string, file string, sha256 string, bytes long, rows long, columns string").json(f"{folder}/manifest")


def checked_artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """(artefact, file, state): ok, changed, missing (only in the manifest) or unknown (only in the folder)."""
    there = file_hashes(spark, f"{folder}/data").select("file", F.col("sha256").alias("_now"))
    both = read_manifest(spark, folder).where("file IS NOT NULL").join(there, "file", "full")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "unknown").when(F.col("_now") != F.col("sha256"), "changed").otherwise("ok")
    return both.select(F.coalesce("artefact", F.substring_index("file", "/", 1)).alias("artefact"), "file", state.alias("state"))


def import_bundle(spark: SparkSession, folder: str, phases: list[tuple[str, str, Callable[[dict[str, DataFrame], DataFrame], DataFrame]]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Imports the tables of a checked bundle in the order of phases (name, schema, what keeps the rows whose parents were imported before).

    Nothing is imported unless all files are as the manifest says and every table of the phases is there. Returns the tables, and
    (phase, artefact, received, kept) of each.
    """
    states = {(r.artefact, r.state): r["count"] for r in checked_artefacts(spark, folder).groupBy("artefact", "state").count().collect()}  # a row an artefact and state
    wrong = sorted(f"{a} {s}" for a, s in states if s != "ok") + sorted(f"{name} missing" for name, _, _ in phases if not any(a == name for a, _ in states))
    if wrong:
        raise ValueError("bundle not imported: " + ", ".join(wrong))
    done: dict[str, DataFrame] = {}
    told = None
    for number, (name, schema, keep) in enumerate(phases, 1):
        rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(f"{folder}/data/{name}")
        done[name] = keep(done, rows)
        own = rows.agg(F.count("*").alias("received")).join(F.broadcast(done[name].agg(F.count("*").alias("kept")))).select(F.lit(number).alias("phase"), F.lit(name).alias("artefact"), "received", "kept")
        told = own if told is None else told.unionByName(own)
    return done, told
