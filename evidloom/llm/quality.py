"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are the trigrams of its bytes' classes (letters by case, digits, white space and
each sign as itself), and counts of words that repeat; none names a topic, a language or a source.
No word itself is a term: the space holds shape and repetition only, so texts whose fault is in
their choice or order of words, with equal shape, are not told apart. Weighted term vectors of at most ``sample`` labelled documents are
decomposed, and every document is placed in the space of the leading ``rank`` directions. Its
cosine with all labelled vectors, a broadcast matrix of bounded size, is computed exactly, in
blocks of documents, and the ``neighbours`` nearest vote with weights by similarity. Votes are
weighed back to the frequencies of the labels.

Documents are only scanned; nothing is shuffled but ids of labels. A null text is the empty one
and, like any text without terms, gets the frequency of label 1 as its score. Without labels
every score is 0.5. Labels given twice count once, as the least, and so do texts given twice to an
id, in learning. Of neighbours that are alike at the last place any may vote.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evidloom.llm.scratch import shielded, small_batches
from evidloom.llm.textvec import NOT_SPACE, mix, slabs, span_hashes, tidy, words

SAMPLE = 6000
RANK = 32
NEIGHBOURS = 25
TERMS = 1024
_REPEATS = 8


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % folds == fold, F.lit(False))


def _classes() -> np.ndarray:
    t = np.arange(256, dtype=np.uint64)
    t[[*range(97, 123), *range(128, 256)]] = 97
    t[65:91] = 65
    t[48:58] = 48
    t[9:14] = 32
    return mix(t + np.uint64(1))


_CLASS = _classes()


def term_counts(column):
    """(first document, counts by document and term) for each slab of an Arrow column."""
    for slab in slabs(column):
        n = len(slab)
        c = _CLASS[slab.data]
        out = np.zeros((n, TERMS + _REPEATS), np.float32)
        if len(c) > 2:
            doc = np.repeat(np.arange(n), np.diff(slab.offsets))
            one = (c[:-2] * np.uint64(3) + c[1:-1] * np.uint64(5) + c[2:] * np.uint64(7)) * np.uint64(0x9E3779B97F4A7C15)
            term = (one >> np.uint64(64 - 10)).astype(np.int64)
            same = doc[:-2] == doc[2:]
            out[:, :TERMS] = np.bincount((doc[:-2] * TERMS + term)[same], minlength=n * TERMS).reshape(n, TERMS)
        w, data = words(slab, NOT_SPACE)
        h = span_hashes(data, w.starts, w.ends)
        wdoc = np.repeat(np.arange(n), np.diff(w.offsets))
        for k in range(1, _REPEATS):  # words equal to that k places before
            if len(h) > k:
                again = (h[k:] == h[:-k]) & (wdoc[k:] == wdoc[:-k])
                out[:, TERMS + k - 1] = np.bincount(wdoc[k:][again], minlength=n)
        for d in range(n):
            own = h[w.offsets[d] : w.offsets[d + 1]]
            out[d, TERMS + _REPEATS - 1] = len(own) - len(np.unique(own)) if len(own) else 0
        yield slab.first, out


@dataclass
class Model:
    """What the tasks need: term weights, directions, labelled vectors and their votes."""

    idf: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    frequency: float
    neighbours: int

    def place(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.idf
        x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)) @ self.directions
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.frequency)
        cosine = self.place(counts) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 8
        share = [self.labels.mean(), 1 - self.labels.mean()]
        back = np.where(self.labels == 1, self.frequency / max(share[0], 1e-9), (1 - self.frequency) / max(share[1], 1e-9))[near]
        weight = weight * back
        total = weight.sum(axis=1)
        return np.where(total > 1e-9, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-9), self.frequency)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnt: Column, sample: int) -> tuple[DataFrame, float]:
    """Texts and labels of at most ``sample`` documents, half of each label where there are as many, and the frequency of 1."""
    known = labels.where(F.col(label).isNotNull() & learnt).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    n, ones = known.agg(F.count("*"), F.sum("label")).first()
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for v in (0, 1)]
    chosen = F.broadcast(parts[0].union(parts[1]))
    # A row an id, of the least text, so that an id that very many rows have stays one.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows, (ones / n if n else 0.5)


def _count_rows(batches):
    for batch in batches:
        counts = [x for _, block in term_counts(batch.column("text")) for x in block]
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array([x.tobytes() for x in counts], pa.binary())], names=["doc_id", "label", "counts"])


def fit(docs: DataFrame, labels: DataFrame, label: str, learnt: Column, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Learns from at most ``sample`` rows of ``labels`` for which ``learnt`` holds."""
    texts, frequency = labelled_sample(docs, labels, label, learnt, sample)
    rows = texts.mapInArrow(_count_rows, "doc_id long, label int, counts binary").toPandas().sort_values(["doc_id", "counts"], kind="stable")
    width = TERMS + _REPEATS
    if rows.empty:
        return Model(np.ones(width, np.float32), np.zeros((width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), frequency, neighbours)
    x = np.stack([np.frombuffer(b, np.float32) for b in rows.counts])
    idf = (1 + np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0)))).astype(np.float32)
    x = np.sqrt(x) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    values, directions = np.linalg.eigh((x.T @ x).astype(np.float64))
    directions = directions[:, np.argsort(-values)[:rank]].astype(np.float32)
    model = Model(idf, directions, np.zeros((0, rank), np.float32), rows.label.to_numpy(np.float32), frequency, neighbours)
    at = x @ directions
    model.vectors = (at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return model


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            scores = [model.scores(counts) for _, counts in term_counts(batch.column("text"))]
            out = np.clip(np.concatenate(scores), 0, 1) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.astype(np.float64))], names=[*batch.schema.names, "_score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with _score; any columns stay."""
    small_batches(docs.sparkSession)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(tidy(_score(docs.sparkSession.sparkContext.broadcast(model))), f"{fields}_score double")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; learns from labels outside the held-out fold."""
    model = fit(docs, labels, "quality", ~held_out("doc_id", folds, fold), **how)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, **how) -> DataFrame:
    """``docs`` without those of a score under 0.5."""
    model = fit(docs, labels, "quality", ~held_out("doc_id", folds, fold), **how)
    rows, back = shielded(docs, "doc_id", "text")
    return back(scored(rows, model).where("_score >= 0.5"))
