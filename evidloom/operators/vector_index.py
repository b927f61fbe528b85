"""Search for the nearest vectors by cosine: an inverted-list index over k-means cells, and exactly.

The index is a table of unit vectors, each in the cell whose centre is nearest, partitioned by cell; a
cell is cut into slices of about ``SLICE`` rows, so that a cell with a third of all rows is many. A query
is held against the slices of its nearest ``probes`` cells, block by block: a task multiplies the vectors
of one slice with at most ``ASKED`` queries and keeps some of the best of each. Exact search holds it
against all slices. Centres and the number of probes are learnt from a bounded sample; all rows are indexed.

Vectors that are null, empty, of length zero or not of the index's length have no direction and are not
indexed; as queries they get no rows. Equal scores are ordered by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidloom.functions.vectors import norm
from evidloom.tables import stored

SLICE = 8192
ASKED = 1024
SAMPLE = 20_000  # rows that centres are learnt from, and
TUNED = 2_000  # of these, rows among which probes are tried out


def unit(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of length one."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where("v IS NOT NULL AND size(v) > 0").withColumn("n", norm(F.col("v"))).where("n > 0 AND n < double('infinity')")
    return rows.select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def nearest_centres(rows: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    """``rows`` (id, v) with the numbers of the nearest centres, nearest first; centres are a sent array of a few megabytes."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            own = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("v")), sent.value.shape[1]))
            x = own.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, sent.value.shape[1])
            near = x @ sent.value.T
            if most == 1:
                cells = near.argmax(1)[:, None]
            else:
                cells = np.argsort(-near, axis=1, kind="stable")[:, :most]
            offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("v"), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel().astype(np.int32)))], ["id", "v", "cells"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, v array<double>, cells array<int>")


@dataclass
class VectorIndex:
    table: DataFrame  # id, v, slice, cell
    slices: DataFrame  # cell, n: slices of each cell
    centres: np.ndarray
    probes: int


def fitted_centres(rows: DataFrame, cells: int, seed: int = 7) -> tuple[np.ndarray, pd.DataFrame]:
    """Centres of unit length by spherical k-means over the ``SAMPLE`` rows of least hash, and ``TUNED`` of them."""
    sample = rows.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(SAMPLE)
    learnt, _ = stored(sample.select("id", array_to_vector("v").alias("features"), "v"), "sample")
    common = learnt.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    learnt = learnt.where(F.size("v") == (common.d if common else 0))
    few = learnt.select("v").orderBy("id").limit(TUNED).toPandas()
    if not len(few):
        return np.zeros((1, 1)), few
    model = KMeans(k=max(2, min(cells, len(few))), seed=seed, maxIter=15, distanceMeasure="cosine").fit(learnt.coalesce(8)) if cells > 1 and len(few) > 1 else None
    c = np.stack(model.clusterCenters()) if model else np.stack(few["v"][:1])
    return c / np.maximum(np.sqrt((c**2).sum(1))[:, None], 1e-12), few


def enough_probes(few: pd.DataFrame, centres: np.ndarray, recall: float, k: int) -> int:
    """The least number of cells to look into for that recall, among ``TUNED`` sampled rows: each tenth asks for its k nearest others."""
    if len(few) < 2:
        return len(centres)
    x = np.stack(few["v"])
    asked = x[::10]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked)) * 10] = -2
    near = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each cell in a query's order
    need = np.sort(np.take_along_axis(place, (x @ centres.T).argmax(1)[near], 1).ravel())
    return min(len(centres), int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1)


def vector_index(vectors: DataFrame, id_col: str, vector_col: str, cells: int = 64, recall: float = 0.97, k: int = 20) -> VectorIndex:
    """Indexes every vector. ``recall`` of the ``k`` nearest is aimed at when the number of probes is chosen on the sample.

    One cell, cut into slices, is enough for exact search, and nothing is learnt for it.
    """
    rows, _ = stored(unit(vectors, id_col, vector_col), "unit")
    centres, few = fitted_centres(rows, cells)
    placed = nearest_centres(rows, centres, 1).select("id", "v", F.element_at("cells", 1).alias("cell"))
    # Slices: rows of a cell are dealt out by hash, which needs the cell's size first (a row a cell).
    placed, _ = stored(placed, "placed")
    slices, _ = stored(placed.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("n")), "slices")
    dealt = placed.join(F.broadcast(slices), "cell").withColumn("slice", F.pmod(F.xxhash64(F.col("id").cast("string"), "v"), F.col("n")).cast("int"))
    table, _ = stored(dealt.select("id", "v", "slice", "cell"), "cells", ["cell"])
    return VectorIndex(table, slices, centres, enough_probes(few, centres, recall, k))


def _best(most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Scores of a slice's vectors (left) for some queries (right)."""
        out = {"query_id": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            v = left["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(left.num_rows, -1)
            q = right["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(right.num_rows, -1)
            ids = left["id"].combine_chunks()
            rank = pa.compute.rank(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            for first in range(0, len(q), 128):
                score = np.round(q[first : first + 128] @ v.T, 12)
                for i, s in enumerate(score):
                    n = min(most, len(s))
                    cut = -np.partition(-s, n - 1)[n - 1]
                    some = np.flatnonzero(s >= cut)
                    some = some[np.lexsort((rank[some], -s[some]))[:n]]
                    out["query_id"].append(right["query_id"].slice(first + i, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))))
                    out["id"].append(ids.take(pa.array(some)))
                    out["score"].append(pa.array(s[some]))
        kinds = {"query_id": right.schema.field("query_id").type, "id": left.schema.field("id").type, "score": pa.float64()}
        return pa.table({c: pa.chunked_array(out[c], kinds[c]) for c in out})

    return run


def search(index: VectorIndex, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, least: float = 0.0, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of each query, itself included if it is indexed.

    Twice k candidates are fetched by score and id; those under ``least`` go, scores are rounded to six
    digits, and the k best of these remain. ``probes`` replaces the index's number of cells to look into.
    """
    asked = unit(queries, id_col, vector_col).withColumnRenamed("id", "query_id").withColumnRenamed("v", "q")
    near = nearest_centres(asked.toDF("id", "v"), index.centres, len(index.centres) if exact else (probes or index.probes))
    pieces = near.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.explode("cells").alias("cell")).join(F.broadcast(index.slices), "cell")
    pieces = pieces.select("query_id", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"))
    # Queries of a slice are asked in groups of about ASKED, each of which gets a copy of the slice.
    many = pieces.groupBy("cell", "slice").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("m"))
    many, _ = stored(many, "asked")
    pieces = pieces.join(many, ["cell", "slice"]).withColumn("part", F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.col("m")).cast("int")).drop("m")
    copies = index.table.join(many, ["cell", "slice"]).select("id", "v", "cell", "slice", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("part"))
    keys = ["cell", "slice", "part"]
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {index.table.schema['id'].dataType.simpleString()}, score double"
    found = copies.groupBy(*keys).cogroup(pieces.groupBy(*keys)).applyInArrow(_best(2 * k), kinds)
    fetched = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("_rn", F.row_number().over(fetched)).where(F.col("_rn") <= 2 * k).where(F.col("score") >= least).withColumn("score", F.round("score", 6))
    return ranked.withColumn("rank", F.row_number().over(fetched)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, shared): how many of a query's exact rows were found, counting others of the same score as found."""
    worst = exact.groupBy("query_id").agg(F.min("score").alias("_least"), F.count("*").alias("wanted"))
    own = found.join(worst, "query_id", "right").groupBy("query_id", "wanted").agg(F.count_if(F.col("score") >= F.col("_least")).alias("shared"))
    return own.select("query_id", "wanted", F.least("wanted", "shared").alias("shared"))
