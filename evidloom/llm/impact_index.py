"""Exact top-k inner products over an impact-ordered index of integer vectors, a score at a time.

``impact_index`` writes the vectors in blocks. In a block, each component of a vector is a posting of
its dimension; postings are cut into levels by the size of the component, and a level's quantised
impact is the mean size of its postings. A segment holds the postings of one level, dimension and
sign. Segments are kept by descending impact, and each level states for every vector the length of
what is left of it once all levels so far are taken off: the vector less its quantised postings.

``top_k`` takes queries in slabs and meets every slab with every block. Segments are processed by
descending impact; each adds its impact times the query's component to the accumulators of its
vectors. After a level, a vector's score differs from its accumulator by at most the query's length
times the length of what is left (Cauchy and Schwarz). The exact scores of a few leading vectors give
a score that the k-th best reaches at least. Vectors that cannot reach it are out, which is the proof
on which processing stops once few are left; these are scored exactly. Nothing is ruled out otherwise.

Each slab and block give k rows a query, which are merged by query. A block holds ``BLOCK`` components
(about 16,000 vectors of 64), a slab ``SLAB`` queries, so a task's memory does not depend on the data.

Vectors that are null or hold a null or non-finite component take no part. Vectors of different lengths
do not meet; empty ones score 0 with each other. Repeated rows are vectors of their own, also as
queries. Equal scores are ordered by id, then null ids, then by row. Where products of a block and a
slab may pass 2**53, no bound is trusted and all are scored, in 64-bit integers that wrap around;
components are held to 64 bits. Other columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evidloom.llm.scratch import small_batches, written
from evidloom.llm.textvec import tidy

BLOCK = 1 << 20
SLAB = 512
AT_ONCE = 128  # queries that share accumulators
#: Shares of a block's postings, by descending size, at which levels end.
LEVELS = (0.01, 0.03, 0.06, 0.1, 0.15, 0.21, 0.28, 0.36, 0.45, 0.55, 0.66, 0.8, 1.0)
FEW = 0.01  # share of a block's vectors that may be left for exact scoring before the last level

_INDEX = "d int, block long, part int, n int, rows binary, ids binary, known binary, vectors binary, impact double, dims binary, counts binary, members binary, left binary"


def _integers(batches, factor: float):
    """(rows, ids, whether known, integer vectors) of each length in a batch."""
    for batch in batches:
        v = batch.column("v")
        size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = v.flatten()
        x = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * factor)
        ends = np.append(0, np.cumsum(size))
        bad = np.append(0, np.cumsum(~np.isfinite(x)))[ends]
        good = (np.diff(bad) == 0) & v.is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("id")
        known, ids, row = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), batch.column("row").to_numpy()
        for d in np.unique(size[good]).tolist():
            of = np.flatnonzero(good & (size == d))
            own = x[(ends[of][:, None] + np.arange(d)).ravel()].reshape(len(of), d)
            top = own >= 2.0**63
            whole = np.where(top, np.iinfo(np.int64).max, np.clip(own, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64))
            yield d, row[of], ids[of], known[of], whole


def _gathered(batches, factor: float, most):
    """The same with up to ``most(d)`` vectors together."""
    open_: dict[int, list] = {}
    for d, *columns in _integers(batches, factor):
        held = open_.setdefault(d, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, d), np.int64)])
        held[:] = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        while len(held[0]) >= most(d):
            yield d, *[x[: most(d)] for x in held]
            held[:] = [x[most(d) :] for x in held]
    for d, held in open_.items():
        if len(held[0]):
            yield d, *held


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def segments(vectors: np.ndarray):
    """(impact, dimensions, counts and vectors of each segment, length of what is left of each vector) by descending impact."""
    n, d = vectors.shape
    size = np.abs(vectors.astype(np.float64))
    ordered = np.sort(size, axis=None)[::-1]
    left, above = vectors.astype(np.float64), np.inf
    for share in LEVELS if n and d else ():
        least = 0.0 if share == 1 else ordered[min(math.ceil(share * n * d), n * d) - 1]
        inside = (size >= least) & (size < above) & (size > 0)
        above = min(above, least)
        if not inside.any():
            continue
        impact = float(np.round(size[inside].mean()))
        dims, counts, members = [], [], []
        for k in range(d):
            for sign in (1, -1):
                own = np.flatnonzero(inside[:, k] & (vectors[:, k] > 0 if sign > 0 else vectors[:, k] < 0))
                if len(own):
                    dims.append(sign * (k + 1))
                    counts.append(len(own))
                    members.append(own.astype(np.int32))
                    left[own, k] -= sign * impact
        # A little longer, so that rounding never makes it too short.
        yield impact, np.array(dims, np.int32), np.array(counts, np.int32), np.concatenate(members), (np.sqrt((left**2).sum(1)) * (1 + 1e-6) + 1e-6).astype(np.float32)


def _indexed(factor: float, block: int):
    def run(batches):
        for number, (d, rows, ids, known, vectors) in enumerate(_gathered(batches, factor, lambda d: max(256, block // max(d, 1)))):
            base = {"d": d, "block": (_partition() << 33) + number, "n": len(rows)}
            out = [base | {"part": 0, "rows": rows.astype(np.int64).tobytes(), "ids": ids.astype(np.int64).tobytes(), "known": known.tobytes(), "vectors": vectors.tobytes()}]
            for part, (impact, dims, counts, members, left) in enumerate(segments(vectors), 1):
                out.append(base | {"part": part, "impact": impact, "dims": dims.tobytes(), "counts": counts.tobytes(), "members": members.tobytes(), "left": left.tobytes()})
            for row in out:
                yield pa.RecordBatch.from_pylist([row], _SCHEMA)

    return tidy(run)


_BYTES = pa.binary()
_SCHEMA = pa.schema([("d", pa.int32()), ("block", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), *[(k, _BYTES) for k in ("rows", "ids", "known", "vectors")], ("impact", pa.float64()), *[(k, _BYTES) for k in ("dims", "counts", "members", "left")]])
_SLAB_SCHEMA = pa.schema([("d", pa.int32()), ("slab", pa.int64()), ("rows", _BYTES), ("ids", _BYTES), ("vectors", _BYTES)])


def _slabs(factor: float):
    def run(batches):
        for number, (d, rows, ids, _, vectors) in enumerate(_gathered(batches, factor, lambda d: SLAB)):
            yield pa.RecordBatch.from_pylist([{"d": d, "slab": (_partition() << 33) + number, "rows": rows.astype(np.int64).tobytes(), "ids": ids.astype(np.int64).tobytes(), "vectors": vectors.tobytes()}], _SLAB_SCHEMA)

    return tidy(run)


def _scores(vectors: np.ndarray, queries: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of rows, exact."""
    if small:
        return np.einsum("ij,ij->i", vectors.astype(np.float64), queries.astype(np.float64)).astype(np.int64)
    with np.errstate(over="ignore"):
        return np.einsum("ij,ij->i", vectors, queries)


def block_top(k: int, rows, ids, known, vectors, levels, query_rows, queries, seen: list | None = None):
    """(place of the query, place of the vector, score) of the k best of a block for each query, by descending impact.

    ``levels`` gives what ``segments`` gives; ``seen`` gets (levels processed, vectors scored exactly) for each group of queries.
    """
    n, d = vectors.shape
    bound = d * float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(vectors.astype(np.float64)).max(initial=0))
    small, kind = bound < 2**52, np.float32 if bound < 2**23 else np.float64
    own_order = np.argsort(rows)
    at = np.searchsorted(rows[own_order], query_rows)
    mine = np.where((at < n) & (rows[own_order][np.minimum(at, n - 1)] == query_rows), own_order[np.minimum(at, n - 1)], -1)
    levels = list(levels) if small else []
    out = []
    for first in range(0, len(queries), AT_ONCE):
        q, own = queries[first : first + AT_ONCE], mine[first : first + AT_ONCE]
        m, here = len(q), np.flatnonzero(mine[first : first + AT_ONCE] >= 0)
        pairs = None
        if levels and n > 4 * k:
            weights, length = q.astype(kind).T.copy(), np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
            sums, whole = np.zeros((n, m), kind), np.sqrt((vectors.astype(np.float64) ** 2).sum(1).mean())
            for number, (impact, dims, counts, members, left) in enumerate(levels, 1):
                start = 0
                for dim, count in zip(dims.tolist(), counts.tolist(), strict=True):
                    sums[members[start : start + count]] += kind(impact if dim > 0 else -impact) * weights[abs(dim) - 1]
                    start += count
                last = number == len(levels)
                if not last and left.mean() > 0.3 * whole:
                    continue
                # k of the leading vectors, scored exactly: the k-th best reaches the least of them.
                sums[own[here], here] = -np.inf
                lead = _leading(sums, k)
                score = _scores(vectors[lead.ravel()], np.repeat(q, lead.shape[1], 0), True).reshape(lead.shape)
                score = np.where(lead == own[:, None], -np.iinfo(np.int64).max, score)
                reach = -np.sort(-score, axis=1)[:, k - 1]
                possible = sums + left[:, None] * length.astype(kind) * kind(1.00001) >= (reach - 1).astype(kind)
                if last or possible.sum() <= FEW * n * m:
                    pairs = np.nonzero(possible.T)
                    break
            if seen is not None:
                seen.append((number, len(pairs[0])))
        if pairs is None:
            pairs = np.repeat(np.arange(m), n), np.tile(np.arange(n), m)
            other = own[pairs[0]] != pairs[1]
            pairs = pairs[0][other], pairs[1][other]
        j, r = pairs
        score = np.concatenate([_scores(vectors[r[a : a + 65536]], q[j[a : a + 65536]], small) for a in range(0, len(j), 65536)] or [np.zeros(0, np.int64)])
        order = np.lexsort((rows[r], ids[r], ~known[r], -score.astype(object) if not small else -score, j))
        j, r, score = j[order], r[order], score[order]
        place = np.arange(len(j)) - np.searchsorted(j, j)
        best = place < k
        out.append((first + j[best], r[best], score[best]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def _leading(sums: np.ndarray, k: int) -> np.ndarray:
    """For each query, some k + 1 vectors or more with large accumulators: the largest of stretches of vectors where there are many."""
    n, m = sums.shape
    wide = n // (4 * k + 4)
    if wide > 1:
        cut = sums[: n // wide * wide].reshape(-1, wide, m)
        lead = cut.argmax(1)
        top = np.take_along_axis(cut, lead[:, None], 1)[:, 0]
        some = np.argpartition(-top, k, axis=0)[: k + 1]
        return (some * wide + np.take_along_axis(lead, some, 0)).T
    return np.argpartition(-sums, min(k, n - 1), axis=0)[: k + 1].T


def _met(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        parts = {p: i for i, p in enumerate(left["part"].to_pylist())}
        if 0 in parts and right.num_rows:
            take = lambda name, part, kind: np.frombuffer(left[name][parts[part]].as_py(), kind)
            rows, ids, known = take("rows", 0, np.int64), take("ids", 0, np.int64), take("known", 0, bool)
            d = left["d"][0].as_py()
            vectors = take("vectors", 0, np.int64).reshape(len(rows), d)
            levels = [(left["impact"][parts[p]].as_py(), take("dims", p, np.int32), take("counts", p, np.int32), take("members", p, np.int32), take("left", p, np.float32)) for p in sorted(parts) if p]
            for i in range(right.num_rows):
                query_rows, query_ids = (np.frombuffer(right[c][i].as_py(), np.int64) for c in ("rows", "ids"))
                queries = np.frombuffer(right["vectors"][i].as_py(), np.int64).reshape(len(query_rows), d)
                j, r, score = block_top(k, rows, ids, known, vectors, levels, query_rows, queries)
                out["query"].append(query_rows[j])
                out["query_id"].append(query_ids[j])
                out["row"].append(rows[r])
                out["vec_id"].append(np.ma.masked_array(ids[r], ~known[r]))
                out["score"].append(score)
        masked = [pa.array(x.data, pa.int64(), mask=x.mask if x.mask.shape else None) for x in out["vec_id"]]
        return pa.table({name: pa.chunked_array(masked if name == "vec_id" else [pa.array(x, pa.int64()) for x in out[name]], pa.int64()) for name in out})

    return run


def impact_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 256.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(numbered vectors, index): both written. A row of the index is a level of a block, or (part 0) the block's vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows, _ = written(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")), "vectors")
    total = rows.agg(F.sum(F.coalesce(F.size("v"), F.lit(0)) + 1)).first()[0] or 0
    index, _ = written(rows.repartition(max(1, math.ceil(total / block))).mapInArrow(_indexed(factor, block), _INDEX), "impacts")
    return rows, index


def top_k(rows: DataFrame, index: DataFrame, queries: str, k: int = 5, factor: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each numbered vector that meets the condition ``queries`` on id, the k best others."""
    asked = rows.where(queries)
    many = asked.count()
    slabs, _ = written(asked.repartition(max(1, math.ceil(many / SLAB))).mapInArrow(_slabs(factor), "d int, slab long, rows binary, ids binary, vectors binary"), "slabs")
    # Every block with every slab of its length: a row of numbers each, then both sides come to it.
    meetings = index.where("part = 0").select("d", "block").join(slabs.select("d", "slab"), "d").select("block", "slab")
    left, right = (x.toDF(*x.columns) for x in (index.join(meetings, "block"), slabs.join(meetings, "slab")))
    found = left.groupBy("block", "slab").cogroup(right.groupBy("block", "slab")).applyInArrow(_met(k), "query long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
