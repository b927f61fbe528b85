"""Missing values of customers' mean prices by priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidloom.operators import imputation
from evidloom.plans.registry import query, table

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_COLUMNS = [f"p{i}" for i in range(1, 6)]
_PRICES = "p AS (SELECT c_custkey, " + ", ".join(f"avg(o_totalprice) FILTER (WHERE o_orderpriority = '{p}' AND o_orderstatus <> 'P') AS p{i}" for i, p in enumerate(_PRIORITIES, 1)) + " FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)"
_ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in _COLUMNS)


def _prices(spark, sf):
    """A customer's mean price of settled orders of each priority; null where there are none."""
    j = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.expr("c_custkey = o_custkey"), "left")
    return j.groupBy("c_custkey").agg(*[F.avg(F.when((F.col("o_orderpriority") == p) & (F.col("o_orderstatus") != "P"), F.col("o_totalprice"))).alias(f"p{i}") for i, p in enumerate(_PRIORITIES, 1)])


def _rounded(df):
    return df.select("c_custkey", *[F.round(c, 4).alias(c) for c in df.columns if c != "c_custkey"])


@query("price_null_shares", f"WITH {_PRICES} SELECT " + ", ".join(f"round(avg(({c} IS NULL)::INT), 6) AS {c}" for c in _COLUMNS) + " FROM p")
def price_null_shares(spark, sf):
    return imputation.null_shares(_prices(spark, sf), _COLUMNS).select(*[F.round(c, 6).alias(c) for c in _COLUMNS])


@query("prices_by_mean", f"WITH {_PRICES} SELECT c_custkey, " + ", ".join(f"round(coalesce({c}, (SELECT avg({c}) FROM p)), 4) AS {c}" for c in _COLUMNS) + " FROM p")
def prices_by_mean(spark, sf):
    return _rounded(imputation.handled(_prices(spark, sf), "c_custkey", _COLUMNS, "mean", threshold=0.9))


@query("prices_of_whole_rows", f"WITH {_PRICES} SELECT c_custkey, {_ROUNDED} FROM p WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _COLUMNS))
def prices_of_whole_rows(spark, sf):
    return _rounded(imputation.handled(_prices(spark, sf), "c_custkey", _COLUMNS, "drop", threshold=0.9))


def _knn_sql() -> str:
    both = " + ".join(f"(a.{c} - b.{c} IS NOT NULL)::INT" for c in _COLUMNS)
    square = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in _COLUMNS)
    parts, columns = [], []
    for c in _COLUMNS:
        parts.append(
            f"d_{c} AS (SELECT a.c_custkey, b.{c} AS v, sqrt(5.0 / ({both}) * ({square})) AS d, row_number() OVER (PARTITION BY a.c_custkey ORDER BY sqrt(5.0 / ({both}) * ({square})), b.h) AS rn FROM p a JOIN r b ON a.{c} IS NULL AND b.{c} IS NOT NULL AND ({both}) > 0), "
            f"f_{c} AS (SELECT c_custkey, CASE WHEN min(d) = 0 THEN avg(v) FILTER (WHERE d = 0) ELSE sum(v / d) / sum(1 / d) END AS v FROM d_{c} WHERE rn <= 5 GROUP BY 1)"
        )
        columns.append(f"round(coalesce(p.{c}, f_{c}.v, (SELECT avg({c}) FROM p)), 4) AS {c}")
    joins = " ".join(f"LEFT JOIN f_{c} ON f_{c}.c_custkey = p.c_custkey" for c in _COLUMNS)
    return f"WITH {_PRICES}, r AS (SELECT *, md5(c_custkey::VARCHAR) AS h FROM p ORDER BY h, c_custkey LIMIT {imputation.REFERENCE}), {', '.join(parts)} SELECT p.c_custkey, {', '.join(columns)} FROM p {joins}"


@query("prices_by_neighbours", _knn_sql())
def prices_by_neighbours(spark, sf):
    return _rounded(imputation.handled(_prices(spark, sf), "c_custkey", _COLUMNS, "knn", threshold=0.9))
