"""Language identification in two steps: the family first, then the language within it.

Features are hashed pairs and triples of letters (bytes of letters, other characters as word
ends), root-scaled to unit length. Families are separated one-versus-one by linear support
vector machines, and so are the languages of each family; all are Spark ML models fitted on at
most ``per_language`` documents a language. A text's language is that with the most won
comparisons, ties by total margin; the score is the product of the two steps' confidence.

Documents are only scanned: once for the ids to learn from, once for their texts, once to predict. A
text that is null or has no letter is ``und`` with score 0, as is every text if no language is learnt.
A language of no known family is a family of its own. Rows that repeat an id and language teach once,
by the least text, and are predicted each; ids that are null teach nothing. Whole texts are read, of any
length; other columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidloom.llm.quality import held_out
from evidloom.llm.scratch import remove, small_batches, written
from evidloom.llm.textvec import LOWER, slabs, tidy

PER_LANGUAGE = 1500
FIT_PARTS = 4
TERMS = 512  # of pairs, and of triples

#: Families of common language codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = LOWER.copy()
_LETTER[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def family(code: str) -> str:
    return _FAMILY.get(code.lower().replace("_", "-").split("-")[0], code)


def letter_features(column):
    """A unit vector of pair and triple frequencies, and whether there is a letter, for each text."""
    for slab in slabs(column):
        n = len(slab)
        out = np.zeros((n, 2 * TERMS), np.float32)
        some = np.zeros(n, bool)
        if len(slab.data) > 0:
            c = _LETTER[slab.data].astype(np.uint32)
            doc = np.repeat(np.arange(n), np.diff(slab.offsets))
            letters = np.bincount(doc[c != 32], minlength=n)
            plain = np.bincount(doc[(c >= 97) & (c <= 122)], minlength=n) > 0
            some = plain.copy()
            for d in np.flatnonzero((letters > 0) & ~plain):  # only characters beyond ASCII
                some[d] = any(ch.isalpha() for ch in slab.data[slab.offsets[d] : slab.offsets[d + 1]].tobytes().decode())
            for k in (2, 3):
                if len(c) >= k:
                    code = sum(c[i : len(c) - k + 1 + i] << np.uint32(8 * i) for i in range(k))
                    term = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 9)).astype(np.int64)
                    first = doc[: len(c) - k + 1]
                    use = (first == doc[k - 1 :]) & ((c[: len(c) - k + 1] != 32) | (c[1 : len(c) - k + 2] != 32))
                    at = (k - 2) * TERMS
                    out[:, at : at + TERMS] = np.bincount((first * TERMS + term)[use], minlength=n * TERMS).reshape(n, TERMS)
        x = np.sqrt(out)
        yield x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), some


@dataclass
class Duel:
    """One linear machine: its weights, and the two that it separates (first on the positive side)."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


@dataclass
class Model:
    families: dict[str, list[str]]
    duels: dict[str, list[Duel]]  # by family; under "" between families

    def _winners(self, x: np.ndarray, names: list[str], duels: list[Duel]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the winning names, and confidences."""
        if len(names) == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        wins, margins = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        for d in duels:
            m = x @ d.weights + d.bias
            a, b = names.index(d.first), names.index(d.second)
            wins[:, a] += m > 0
            wins[:, b] += m <= 0
            margins[:, a] += m
            margins[:, b] -= m
        best = np.argmax(wins + 0.4 * np.tanh(margins / len(names)), axis=1)
        top = margins[np.arange(len(x)), best] / (len(names) - 1)
        return best, 1 / (1 + np.exp(-np.clip(3 * top, -30, 30)))

    def predict(self, x: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(x), "und", object), np.zeros(len(x))
        if self.families:
            names = sorted(self.families)
            which, sure = self._winners(x, names, self.duels[""])
            for k, name in enumerate(names):
                own = np.flatnonzero((which == k) & some)
                if len(own):
                    inner, inner_sure = self._winners(x[own], self.families[name], self.duels[name])
                    lang[own] = np.array(self.families[name], object)[inner]
                    score[own] = sure[own] * inner_sure
        return lang, score


def _vectors(batches):
    for batch in batches:
        rows = [v for block, _ in letter_features(batch.column("text")) for v in block]
        yield pa.record_batch([batch.column("lang"), pa.array([v.astype(np.float64).tolist() for v in rows], pa.list_(pa.float64()))], names=["lang", "x"])


def _duels(rows: DataFrame, of: str, names: list[str]) -> list[Duel]:
    out = []
    for a, b in combinations(names, 2):
        pair = rows.where(F.col(of).isin(a, b)).select("x", (F.col(of) == a).cast("double").alias("label"))
        fitted = LinearSVC(featuresCol="x", labelCol="label", maxIter=40, regParam=1e-4, standardization=False).fit(pair)
        out.append(Duel(a, b, np.asarray(fitted.coefficients.toArray(), np.float32), float(fitted.intercept)))
    return out


def _least(most: int):
    """Of the rows of a task, for each language the ``most`` distinct ids of least hash."""

    def run(batches):
        best: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            rows = np.stack((batch.column("h").to_numpy(), batch.column("doc_id").to_numpy()), 1)
            which = lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = np.concatenate((best.get(name, rows[:0]), rows[which == k]))
                best[name] = np.unique(own, axis=0)[:most]
        for name, rows in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["lang", "h", "doc_id"])

    return run


def sampled_ids(known: DataFrame, most: int) -> DataFrame:
    """(doc_id, lang): for each language the ``most`` ids of least hash, in one scan of ids and languages. Written."""
    thin = known.select("lang", F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    few = thin.mapInArrow(_least(most), "lang string, h long, doc_id long").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    return written(few.withColumn("_rn", place).where(F.col("_rn") <= most).select("doc_id", "lang"), "sampled")[0]


def fit(docs: DataFrame, learnt: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from at most ``per_language`` documents of each language for which ``learnt`` holds."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnt)
    chosen = sampled_ids(known, per_language)
    languages = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    if not languages:
        return Model({}, {"": []})
    # A row an id and language, so that an id that very many rows have stays one; the shuffle also sets the scan apart from what follows.
    texts = known.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")
    families: dict[str, list[str]] = {}
    for v in languages:
        families.setdefault(family(v), []).append(v)
    of_family = F.create_map(*[F.lit(x) for v in languages for x in (v, family(v))])
    # Fits are many small jobs over the sample, so it is written and read in a few parts.
    vectors, path = written(texts.mapInArrow(tidy(_vectors), "lang string, x array<double>"), "letters")
    rows = vectors.select("lang", of_family[F.col("lang")].alias("family"), array_to_vector("x").alias("x")).coalesce(FIT_PARTS).cache()
    duels = {"": _duels(rows, "family", sorted(families))}
    for name, members in families.items():
        duels[name] = _duels(rows.where(F.col("family") == name), "lang", members)
    rows.unpersist()
    remove(docs.sparkSession, path)
    return Model(families, duels)


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            lang, score = [], []
            for x, some in letter_features(batch.column("text")):
                a, b = model.predict(x, some)
                lang += a.tolist()
                score += b.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def language(docs: DataFrame, folds: int = 5, fold: int = 0, **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; learns from (text, lang) outside the held-out fold."""
    small_batches(docs.sparkSession)
    model = fit(docs, ~held_out("doc_id", folds, fold), **how)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = texts.mapInArrow(tidy(_predict(docs.sparkSession.sparkContext.broadcast(model))), f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score")
