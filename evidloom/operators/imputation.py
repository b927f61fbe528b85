"""Missing values: columns that miss too many are dropped, the others filled by means, by rows alike, or their rows dropped.

Rows alike are the ``k`` nearest by Euclidean distance over the columns that both rows have, scaled up to
all columns. They are sought, exactly and block by block, among the rows of a reference sample: the
``REFERENCE`` rows of least hash of their key, which is the whole table where it has no more. All rows are filled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

REFERENCE = 5000
BLOCK = 256


def null_shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of nulls of each column; 0 for an empty table."""
    return rows.agg(*[F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)).alias(c) for c in columns])


def dense_columns(rows: DataFrame, columns: list[str], threshold: float = 0.05) -> list[str]:
    """Columns of which no more than that share is null."""
    shares = null_shares(rows, columns).first()
    return [c for c in columns if shares[c] <= threshold]


def mean_filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the mean of their column; those of a column without values stay."""
    means = rows.agg(*[F.avg(c).alias(f"_mean_{i}") for i, c in enumerate(columns)])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_mean_{i}")) for i, c in enumerate(columns)}
    return rows.join(F.broadcast(means)).withColumns(filled).select(rows.columns)


def nearest_filled(x: np.ndarray, donors: np.ndarray, means: np.ndarray, k: int) -> np.ndarray:
    """``x`` with each missing value (nan) the mean of that of the k nearest donors that have it, weighted by 1 / distance.

    Donors at distance 0 count alone. Of donors equally far the earlier come first. A value without donors is its column's mean.
    """
    out = x.copy()
    missing = np.isnan(x)
    for first in range(0, len(x), BLOCK):
        own = first + np.flatnonzero(missing[first : first + BLOCK].any(1))
        if not len(own):
            continue
        square, both = np.zeros((len(own), len(donors))), np.zeros((len(own), len(donors)))
        for c in range(x.shape[1]):
            gap = x[own, c][:, None] - donors[:, c][None, :]
            there = ~np.isnan(gap)
            square += np.where(there, gap, 0.0) ** 2
            both += there
        with np.errstate(divide="ignore", invalid="ignore"):
            distance = np.sqrt(square * (x.shape[1] / both))
        for c in np.flatnonzero(missing[own].any(0)):
            lacks, has = own[missing[own, c]], np.flatnonzero(~np.isnan(donors[:, c]))
            far = distance[np.isin(own, lacks)][:, has]
            far = np.where(np.isnan(far), np.inf, far)
            near = np.argsort(far, axis=1, kind="stable")[:, :k]
            d, v = np.take_along_axis(far, near, 1), donors[has, c][near] if len(has) else np.zeros((len(lacks), 0))
            with np.errstate(divide="ignore"):
                w = np.where(np.isinf(d), 0.0, 1 / d)
            w = np.where(np.isinf(w).any(1)[:, None], np.isinf(w).astype(float), w)
            total = w.sum(1)
            with np.errstate(invalid="ignore"):
                out[lacks, c] = np.where(total > 0, (w * v).sum(1) / total, means[c])
    return out


def knn_filled(rows: DataFrame, key: str, columns: list[str], k: int = 5, reference: int = REFERENCE) -> DataFrame:
    """(key, columns): nulls filled from rows alike, in doubles; other columns are left out."""
    spark = rows.sparkSession
    data = rows.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    sample = data.orderBy(F.md5(F.col(key).cast("string")), key).limit(reference).select(columns).toPandas()  # of a bounded size
    means = np.array([np.nan if v is None else v for v in data.agg(*[F.avg(c) for c in columns]).first()], float)
    sent = spark.sparkContext.broadcast((sample.to_numpy(float), means))

    def run(batches):
        donors, mean = sent.value
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) if batch.num_rows else np.zeros((0, len(columns)))
            filled = nearest_filled(x, donors, mean, k)
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(filled[:, i], from_pandas=True) for i in range(len(columns))]], [key, *columns])

    return data.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in columns))


def handled(rows: DataFrame, key: str, columns: list[str], strategy: str = "mean", threshold: float = 0.05) -> DataFrame:
    """(key, the columns that are dense enough): filled by 'mean' or 'knn', or with the rows that miss any of them dropped ('drop')."""
    kept = dense_columns(rows, columns, threshold)
    few = rows.select(key, *kept)
    if strategy == "drop":
        return few.dropna(subset=kept) if kept else few
    if not kept:
        return few
    return mean_filled(few, kept) if strategy == "mean" else knn_filled(few, key, kept)
