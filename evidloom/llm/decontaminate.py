"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words become one automaton whose states are the distinct sets of places where word
sequences end. A document's words stream through it and the length of the longest match that
ends at each word is tracked; a length of ``window`` or more marks words as hit. Items of fewer
words than a window match as a whole. Words are compared by 64-bit hashes.

The items are dealt by hash into blocks of about ``BLOCK_WORDS`` words. An item of more words is
cut into pieces that overlap by a window less one word, so none is lost. A task builds the
automaton of a block, and it is written; automata are sent to the executors, and pass the driver
one at a time on their way. The documents are read once for any number of blocks, and no text is
shuffled: a task takes batches of some ``HELD`` bytes of text through one automaton after the
other, and holds one at a time.

Null texts and texts without words have no hits. Repeated documents give repeated rows. Items
that are null or without words match nothing; items of equal id count as one; a null id reads
``null``. Texts may be of any length: memory follows the longest. Columns of any names go through.
An empty benchmark hits nothing.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidloom.llm.scratch import shielded, small_batches, written
from evidloom.llm.textvec import WORD, Slab, Words, slabs, span_hashes, tidy, words

WINDOW = 10
BLOCK_WORDS = 200_000
_U = np.uint64
HELD = 16 << 20


class SuffixAutomaton:
    """Of several word sequences; tells which items hold the windows that end at a word."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for name, ids in items:
            last = 0
            for c in ids:
                last = self._extend(last, c)
                self.ends.setdefault(last, set()).add(name)
            if 0 < len(ids) < window:
                self.whole.setdefault(last, []).append((len(ids), name))
        self.children: dict[int, list[int]] = {}
        for v in range(1, len(self.link)):
            self.children.setdefault(self.link[v], []).append(v)
        self._items: dict[int, frozenset[str]] = {}
        self._base: dict[int, int] = {}
        self._short: dict[int, tuple[tuple[int, str], ...]] = {}

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's sequences followed by c, apart from q's longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def holders(self, v: int) -> frozenset[str]:
        """Items that hold the last ``window`` words of the sequences of v."""
        passed = []
        while v not in self._base and self.length[self.link[v]] >= self.window:
            passed.append(v)
            v = self.link[v]
        v = self._base.get(v, v)
        self._base.update(dict.fromkeys(passed, v))
        if v not in self._items:
            found, todo = set(), [v]
            while todo:
                u = todo.pop()
                found |= self.ends.get(u, set())
                todo += self.children.get(u, ())
            self._items[v] = frozenset(found)
        return self._items[v]

    def short(self, v: int) -> tuple[tuple[int, str], ...]:
        """(length, name) of whole short items that end a sequence of v."""
        if v not in self._short:
            out, u = [], v
            while u > 0:
                out += self.whole.get(u, ())
                u = self.link[u]
            self._short[v] = tuple(out)
        return self._short[v]

    def stream(self, ids: list[int], hit: np.ndarray, names: set[str]) -> None:
        """Marks in ``hit`` the words of ``ids`` that stand in a window, and adds the items."""
        nxt, link, length, window, some_short = self.next, self.link, self.length, self.window, bool(self.whole)
        seen: set[int] = set()  # states of which the holders are among the names,
        told: set[int] = set()  # and the states that stand for them
        v = matched = 0
        for i, c in enumerate(ids):
            while v and c not in nxt[v]:
                v = link[v]
                matched = length[v]
            if c not in nxt[v]:
                matched = 0
                continue
            v = nxt[v][c]
            matched += 1
            if matched >= window:
                hit[i - window + 1 : i + 1] = True
                if v not in seen:
                    seen.add(v)
                    found = self.holders(v)
                    if (base := self._base.get(v, v)) not in told:
                        told.add(base)
                        names |= found
            if some_short:
                for n, name in self.short(v):
                    if n <= matched:
                        hit[i - n + 1 : i + 1] = True
                        names.add(name)


def _hashed(text: str) -> np.ndarray:
    slab = next(iter(slabs(pa.array([text]))))
    w, data = words(slab, WORD)
    return span_hashes(data, w.starts, w.ends)


class _Block:
    """An automaton over word numbers, the sorted word hashes that they number, and the shortest window."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.vocabulary = np.unique(np.concatenate([h for _, h in items]))
        self.least = min(window, *(len(h) for _, h in items))
        self.automaton = SuffixAutomaton([(name, np.searchsorted(self.vocabulary, h).tolist()) for name, h in items], window)

    def scan(self, hashes: np.ndarray, offsets: np.ndarray, hit: np.ndarray, names: dict[int, set[str]]) -> None:
        """Streams the runs of known words, at least as long as the shortest window."""
        if not len(hashes):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        cut = np.zeros(len(hashes), bool)
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        before = np.concatenate(([False], known[:-1])) & ~cut
        starts = np.flatnonzero(known & ~before)
        after = np.concatenate((known[1:] & ~cut[1:], [False]))
        ends = np.flatnonzero(known & ~after) + 1
        for a, b in zip(starts, ends, strict=True):
            if b - a >= self.least:
                found: set[str] = set()
                self.automaton.stream(at[a:b].tolist(), hit[a:b], found)
                if found:
                    names.setdefault(int(np.searchsorted(offsets, a, "right")) - 1, set()).update(found)


def _cut(size: int, window: int):
    """Items in pieces of at most ``size`` word hashes, which hold all of their windows."""

    def run(batches):
        size_ = max(size, 2 * window)
        for batch in batches:
            names, pieces = [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = _hashed(text)
                for start in range(0, max(1, len(h) - window + 1), size_ - window + 1) if len(h) else ():
                    names.append(name)
                    pieces.append(h[start : start + size_].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.list_(pa.int64()))], ["name", "words"])

    return run


def _built(window: int):
    def run(table: pa.Table) -> pa.Table:
        items = [(name, np.array(w, np.int64).view(_U)) for name, w in zip(table["name"].to_pylist(), table["words"].to_pylist(), strict=True)]
        return pa.table({"automaton": pa.array([pickle.dumps(_Block(items, window))], pa.binary())})

    return run


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row a block of the items: its automaton. Written."""
    items = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text").distinct()
    pieces, _ = written(items.mapInArrow(_cut(block_words, window), "name string, words array<long>"), "items")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("name", "words"), F.lit(max(1, math.ceil(total / block_words)))))
    return written(dealt.groupBy("block").applyInArrow(_built(window), "automaton binary"), "automata")[0]


def _rest(slab: Slab, d: int, w: Words, spans: list[dict]) -> str:
    """Document d without the words of its spans and what stands between these."""
    raw, kept = slab.data[slab.offsets[d] : slab.offsets[d + 1]].tobytes(), []
    here, base, first = 0, int(slab.offsets[d]), int(w.offsets[d])
    for s in spans:
        kept.append(raw[here : int(w.starts[first + s["start"]]) - base])
        here = int(w.ends[first + s["end"] - 1]) - base
    return b"".join([*kept, raw[here:]]).decode()


def _spans_of(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _groups(batches):
    """Batches in lists of about HELD bytes."""
    group, held = [], 0
    for batch in batches:
        group.append(batch)
        held += batch.column("text").nbytes
        if held >= HELD:
            yield group
            group, held = [], 0
    if group:
        yield group


def _scan(sent: list, max_coverage: float, with_text: bool):
    """All that is told of each document, from all blocks of items."""

    def run(batches):
        only = pickle.loads(sent[0].value) if len(sent) == 1 else None
        for group in _groups(batches):
            held = []
            for batch in group:
                for slab in slabs(batch.column("text")):
                    w, data = words(slab, WORD)
                    held.append((slab, w, span_hashes(data, w.starts, w.ends), np.zeros(len(w.starts), bool), {}))
            for shared in sent:
                block = only or pickle.loads(shared.value)
                for _, w, hashes, hit, names in held:
                    block.scan(hashes, w.offsets, hit, names)
                if not only:
                    vars(shared).pop("_value", None)  # read again from the executor's disk when its turn comes
            found = iter(held)
            for batch in group:
                out, d = _Rows(max_coverage, with_text), 0
                while d < batch.num_rows:
                    slab, w, _, hit, names = next(found)
                    for k in range(len(slab)):
                        out.add(slab, k, w, _spans_of(hit[w.offsets[k] : w.offsets[k + 1]]) if k in names else [], sorted(names.get(k, ())))
                    d += len(slab)
                yield out.beside(batch, batch.schema.names)

    return run


class _Rows:
    """The columns that are told of the documents of a batch."""

    def __init__(self, max_coverage: float, with_text: bool):
        self.max_coverage, self.with_text = max_coverage, with_text
        self.cols: dict[str, list] = {k: [] for k in ("_items", "_n_words", "_n_hit", "_spans", "_clean")}

    def add(self, slab: Slab, d: int, w: Words, spans: list[dict], items: list[str]) -> None:
        n, hit = int(w.offsets[d + 1] - w.offsets[d]), sum(s["end"] - s["start"] for s in spans)
        clean = _rest(slab, d, w, spans) if self.with_text and spans and hit <= self.max_coverage * n else None
        for k, v in zip(self.cols, (items, n, hit, spans, clean), strict=True):
            self.cols[k].append(v)

    def beside(self, batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
        types = (pa.list_(pa.string()), pa.int64(), pa.int64(), _SPANS, pa.string())
        own = [pa.array(v, t) for v, t in zip(self.cols.values(), types, strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *own], names=[*names, *self.cols])


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TOLD = "_items array<string>, _n_words long, _n_hit long, _spans array<struct<start:long,end:long>>, _clean string"


def _scanned(docs: DataFrame, benchmark: DataFrame, columns: list[str], window: int, max_coverage: float, with_text: bool, block_words: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(*columns)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    sent = [spark.sparkContext.broadcast(r.automaton) for r in blocks_of(benchmark, window, block_words).toLocalIterator()]
    return docs.mapInArrow(tidy(_scan(sent, max_coverage, with_text)), fields + _TOLD)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items and hit spans.

    ``benchmark`` has item_id and text. ``items`` are the ids, sorted as strings, of which a
    window occurs; ``spans`` number words, end exclusive.
    """
    out = _scanned(docs, benchmark, ["doc_id", "text"], window, 1.0, False, block_words)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.col("_items").alias("items"), F.col("_spans").alias("spans"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the hit spans, and without the documents of which they cover more than ``max_coverage``.

    Any columns stay; n_chars, where there is one, follows the text.
    """
    rows, back = shielded(docs, "text", "n_chars")
    out = _scanned(rows, benchmark, rows.columns, window, max_coverage, True, block_words)
    out = out.where(F.col("_n_hit") <= max_coverage * F.col("_n_words")).withColumn("text", F.coalesce("_clean", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_clean").isNotNull(), F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out)
