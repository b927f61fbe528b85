"""Maximal periodic runs of words in documents, by a suffix tree.

A run is a stretch of words with smallest period q, at least twice as long as q and of ``least``
words, that neither neighbour extends. The leaves below each inner node of the tree are the places
of one repeated phrase; where two of them are a phrase's length apart and then differ, the phrase
stands twice in a row there and does not go on (a branching tandem repeat). Each inner node lists
the leaves of all its children but the largest, so all lists together hold n log n leaves, and asks
for each whether its partner before or behind it is below the node too. Every run ends in exactly
one such repeat of its smallest period; rotating that to the left as far as the words allow gives
the run, and repeats of the same end that are powers of a shorter period merge into it.

The tree is kept as suffix order, common prefix lengths and their intervals, over all documents of a
slab at once: words are told apart by document, so that no node has leaves of two. Only documents
in which ``least / 2`` consecutive words occur twice get a tree; others hold no run, because a run
agrees with itself a period further on for that many words. Words are told apart by 64-bit hashes.

A null text is the empty one and has no runs. Repeated rows get a row each. Columns other than id
and text are not looked at, so their names may clash. Memory follows a slab (half a megabyte of
text) or the longest document: about 100 bytes a word, and 4 more for each doubling of its longest repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidloom.llm.scratch import small_batches
from evidloom.llm.textvec import NOT_SPACE, mix, slabs, span_hashes, tidy, words

_U = np.uint64
#: Where a document's words are rewritten before the search: (number of words, doc_id) -> (first word rewritten, period), or None.
Edit = Callable[[int, object], tuple[int, int] | None]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... (counts[k] of them) for each k, one after the other."""
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(int(counts.sum()))


def _ranks(codes: np.ndarray, doc: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Tables k = 0, 1, ...: ranks of the 2**k words from each place on, equal where these are; the last ranks whole suffixes.

    Each table has one more entry than there are words, which equals no other. Only places whose rank others share are sorted again.
    """
    n = len(codes)
    word = np.unique(codes, return_inverse=True)[1]
    rank = np.zeros(n, np.int64)
    key, active, span, tables = doc * (int(word.max()) + 1) + word, np.arange(n), 1, []
    while True:
        order = np.argsort(key, kind="stable")
        key, placed = key[order], active[order]
        new = np.append(True, key[1:] != key[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        old = rank[placed]
        block = np.append(True, old[1:] != old[:-1])
        rank[placed] = old + head - np.flatnonzero(block)[np.cumsum(block) - 1]
        tables.append(np.append(rank, -1).astype(np.int32))
        shared = ~(new & np.append(new[1:], True))
        if not shared.any():
            return tables
        active = np.sort(placed[shared])
        on = active + span
        key = rank[active] * (n + 1) + np.where(on < end[active], rank[np.minimum(on, n - 1)] + 1, 0)
        span *= 2


def _children(lcp: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [low, high) of suffixes below each child of an inner node, the child's node, and each node's interval.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i; a node is named by the first i that divides its children.
    """
    low, high, of = [], [], []
    n = len(lcp)
    left, right, node = [0] * n, [0] * n, list(range(n))
    stack = [0]
    for i, v in enumerate([*lcp[1:], 0], 1):
        top = stack[-1]
        while lcp[top] > v:
            stack.pop()
            low.append(top)
            high.append(i)
            of.append(node[top])
            right[node[top]] = i
            top = stack[-1]
        if not v:
            stack = [i]
            if i < n:
                lcp[i] = 0
            continue
        low.append(top)
        high.append(i)
        if lcp[top] == v:
            node[i] = node[top]
            stack[-1] = i
        else:
            left[i] = top
            stack.append(i)
        of.append(node[i])
    return np.array(low, np.int64), np.array(high, np.int64), np.array(of, np.int64), np.array(left, np.int64), np.array(right, np.int64)


def _before(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many words just before a and b agree, none before ``start``."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        x, y = a - (1 << k), b - (1 << k)
        same = (x >= start) & (tables[k][np.maximum(x, 0)] == tables[k][np.maximum(y, 0)])
        step = same * (1 << k)
        a, b, out = a - step, b - step, out + step
    return out


def maximal_runs(codes: np.ndarray, offsets: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, ordered so, of documents whose words have ``codes``."""
    n, none = len(codes), np.zeros((0, 4), np.int64)
    if not n:
        return none
    count = np.diff(offsets)
    doc = np.repeat(np.arange(len(count)), count)
    start, end = np.repeat(offsets[:-1], count), np.repeat(offsets[1:], count)
    tables = _ranks(codes, doc, end)
    rank = tables[-1].astype(np.int64)
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    # Common prefixes of neighbours in suffix order.
    a, b = order[:-1].copy(), order[1:].copy()
    some = np.flatnonzero(tables[0][a] == tables[0][b])
    a, b, common = a[some], b[some], np.zeros(len(some), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        step = (tables[k][np.minimum(a, n)] == tables[k][np.minimum(b, n)]) * (1 << k)
        a, b, common = a + step, b + step, common + step
    lcp = np.zeros(n, np.int64)
    lcp[some + 1] = common
    low, high, of, left, right = _children(lcp.tolist())
    if not len(low):
        return none
    # All children of a node but its largest.
    by = np.lexsort((low - high, of))
    rest = by[np.append(False, of[by][1:] == of[by][:-1])]
    size = high[rest] - low[rest]
    leaf, node = order[_spread(low[rest], size)], np.repeat(of[rest], size)
    depth, low, high = lcp[node], left[node], right[node]
    found = []
    for at in (leaf, leaf - depth):  # the leaf as the first and as the second of the two
        other = at + depth if at is leaf else at
        ok = (at >= start[leaf]) & (at + depth < end[leaf])
        r = rank[np.where(ok, other, n)]
        ok &= (r >= low) & (r < high)
        i, d = at[ok], depth[ok]
        after = np.where(i + 2 * d < end[i], tables[0][np.minimum(i + 2 * d, n)], -2)
        branch = tables[0][i + d] != after
        found.append(np.stack((i[branch] + 2 * d[branch], d[branch]), 1))
    ends = np.unique(np.concatenate(found), axis=0)  # by end, then length of the phrase
    runs = []
    while len(ends):
        first = np.append(True, ends[1:, 0] != ends[:-1, 0])
        e, q = ends[first].T
        i = e - 2 * q
        length = 2 * q + _before(tables, i, i + q, start[i])
        runs.append(np.stack((doc[i], i + 2 * q - length - start[i], length, q), 1))
        # Repeats within the run just found are powers of its period; longer ones are ends of other runs.
        ends = ends[~first & (2 * ends[:, 1] > length[np.cumsum(first) - 1])]
    runs = np.concatenate(runs) if runs else none
    runs = runs[runs[:, 2] >= least]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _repeating(codes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Documents in which ``size`` consecutive words occur twice (by 40-bit hashes: some others perhaps, never fewer)."""
    count = np.diff(offsets)
    if len(codes) < size:
        return np.zeros(0, np.int64)
    power = mix(np.arange(1, size + 1, dtype=_U)) | _U(1)
    rolled = sum(codes[k : len(codes) - size + 1 + k] * power[k] for k in range(size))
    doc = np.repeat(np.arange(len(count)), count)
    inside = doc[: len(rolled)] == doc[size - 1 :]
    key = np.sort((doc[: len(rolled)][inside].astype(_U) << _U(40)) | (mix(rolled[inside]) >> _U(24)))
    return np.unique(key[1:][key[1:] == key[:-1]] >> _U(40)).astype(np.int64)


def _searched(least: int, edit: Edit | None, whole: bool):
    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for slab in slabs(batch.column(1)):
                w, data = words(slab, NOT_SPACE, lower=False)
                codes, place = span_hashes(data, w.starts, w.ends), np.arange(len(w.starts))
                count = np.diff(w.offsets)
                edited = set()
                for d in range(len(slab)) if edit else ():
                    if change := edit(int(count[d]), ids[slab.first + d]):
                        first, period = change
                        place[w.offsets[d] + first : w.offsets[d + 1]] = w.offsets[d] + first + np.arange(count[d] - first) % period
                        edited.add(d)
                if edited:
                    codes = codes[place]
                some = _repeating(codes, w.offsets, (least + 1) // 2)
                runs = maximal_runs(codes[_spread(w.offsets[some], count[some])], np.append(0, np.cumsum(count[some])), least)
                own = np.searchsorted(runs[:, 0], np.arange(len(some) + 1))
                by = {int(d): runs[a:b, 1:] for d, a, b in zip(some, own[:-1], own[1:], strict=True) if b > a}
                raw = data.tobytes()
                for d in range(len(slab)):
                    mine = by.get(d)
                    if mine is None and d not in edited:
                        left = b" ".join(raw[slab.offsets[d] : slab.offsets[d + 1]].split())
                    else:
                        at = place[w.offsets[d] : w.offsets[d + 1]]
                        if mine is not None:
                            cover = np.zeros(len(at) + 1, np.int64)
                            np.add.at(cover, mine[:, 0] + mine[:, 2], 1)
                            np.add.at(cover, mine[:, 0] + mine[:, 1], -1)
                            at = at[np.cumsum(cover)[:-1] == 0]
                        left = b" ".join([raw[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
                    out.append((mine, left))
            yield _row_batch(batch.column(0), out, whole)

    return tidy(run)


def _row_batch(ids, out, whole: bool) -> pa.RecordBatch:
    best = [None if r is None else r[np.lexsort((r[:, 2], r[:, 0], -r[:, 1]))[0]].tolist() for r, _ in out]
    listed = [b"" if r is None else "".join(f"{a},{b},{c}\n" for a, b, c in r.tolist()).encode() for r, _ in out]
    columns = {
        "doc_id": ids,
        "n_runs": pa.array([0 if r is None else len(r) for r, _ in out], pa.int64()),
        **{name: pa.array([x and x[k] for x in best], pa.int64()) for k, name in enumerate(("start", "length", "period"))},
        "exponent_milli": pa.array([x and 1000 * x[1] // x[2] for x in best], pa.int64()),
        "runs_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in listed], pa.string()),
        "collapsed_sha256": pa.array([hashlib.sha256(x).hexdigest() for _, x in out], pa.string()),
    }
    if whole:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        columns["runs"] = pa.array([[] if r is None else [dict(zip(("start", "length", "period"), x, strict=True)) for x in r.tolist()] for r, _ in out], kind)
        columns["collapsed"] = pa.array([x.decode() for _, x in out], pa.string())
    return pa.RecordBatch.from_pydict(columns)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, edit: Edit | None = None, whole: bool = False) -> DataFrame:
    """A row a document: its number of runs, the longest (ties: smallest start, then period), and digests of all runs and of the collapsed text.

    The collapsed text leaves out each word that a run holds after its first period, and joins the rest by one space. With ``whole``
    the columns ``runs`` (array of start, length, period) and ``collapsed`` (the text) follow. ``edit`` rewrites words from some place
    on with a period, before the search. The work is within rows, so nothing is shuffled, and a lost task is run again by itself.
    """
    small_batches(docs.sparkSession)
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if whole:
        schema += ", runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_searched(least, edit, whole), schema)
