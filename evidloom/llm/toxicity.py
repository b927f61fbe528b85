"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities of a fixed lexicon of insults and of word stems that the labelled sample
ties to toxic texts, how near these stand to second-person words, rates of capitals,
exclamations, other signs, digits and obfuscated words, and what of the lexicon shows only once
look-alike signs are read as letters. Trees and calibration are Spark ML models, fitted on at
most ``sample`` labelled rows, part for the trees and part for the calibration.

Documents are only scanned. A null text is the empty one and is scored like any other. Without
labels of both kinds every score is the frequency of label 1 (0 without labels). Labels given
twice count once, as the least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from evidloom.llm.quality import held_out, labelled_sample
from evidloom.llm.textvec import LOWER, WORD, Slab, byte_class, shingles, slabs, span_hashes, words

SAMPLE = 6000
STEMS = 300
STEM_BYTES = (4, 5, 6, 8)
TOXIC_AT = 0.7
NEAR = 3

#: Common insults in four languages.
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile loser losers scum trash garbage worthless pathetic disgusting clown clowns "
    "fool fools ugly filthy vermin pig pigs jerk creep freak hateful crap damn bastard bitch whore slut asshole "
    "dumm dummkopf trottel abschaum müll wertlos erbärmlich widerlich ekelhaft versager schwein dreck arschloch hure "
    "imbécile crétin débile stupide ordure minable dégoûtant perdant salaud connard pute merde abruti "
    "idiota estúpido estúpida imbécil basura escoria patético asqueroso perdedor payaso cerdo puta mierda cabrón tonto"
).split()
#: Second-person words in the same languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split()

_LOOKALIKE = LOWER.copy()
for _a, _b in zip(b"0134578@$!|+", b"oieastbasilt", strict=True):
    _LOOKALIKE[_a] = _b
_SIGNED_WORD = byte_class((0x21, 0x21), (0x24, 0x24), (0x2A, 0x2B), (0x30, 0x39), (0x40, 0x5A), (0x61, 0x7C), (0x80, 0xFF))
_UPPER = byte_class((65, 90))
_LETTERS = byte_class((65, 90), (97, 122), (128, 255))
_DIGIT = byte_class((48, 57))
_SIGN = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
FEATURES = 15


def _hash_words(some) -> np.ndarray:
    if not some:
        return np.zeros(0, np.uint64)
    slab = next(slabs(pa.array([" ".join(some)])))
    w, data = words(slab, WORD)
    return np.unique(span_hashes(data, w.starts, w.ends))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


@dataclass
class Words:
    lexicon: np.ndarray
    second: np.ndarray
    stems: dict[int, np.ndarray]  # by number of bytes


def features(slab: Slab, known: Words) -> np.ndarray:
    """A row of FEATURES for each document of a slab."""
    n = len(slab)
    out = np.zeros((n, FEATURES))
    if not len(slab.data):
        return out
    doc = np.repeat(np.arange(n), np.diff(slab.offsets))
    size = np.maximum(np.diff(slab.offsets), 1)
    per = lambda mask, of=doc: np.bincount(of[mask], minlength=n)
    w, data = words(slab, WORD)
    hashes = span_hashes(data, w.starts, w.ends)
    of = np.repeat(np.arange(n), np.diff(w.offsets))
    n_words = np.maximum(np.diff(w.offsets), 1)
    fixed = _among(hashes, known.lexicon)
    learnt = np.zeros(len(hashes), bool)
    for k, stems in known.stems.items():
        long = w.ends - w.starts >= k
        if len(stems) and long.any():
            learnt[long] |= _among(span_hashes(data, w.starts[long], w.starts[long] + k), stems)
    second = _among(hashes, known.second)
    near = np.zeros(len(hashes), bool)
    for k in range(1, NEAR + 1):
        same = of[k:] == of[:-k]
        near[k:] |= second[:-k] & same
        near[:-k] |= second[k:] & same
    bad = fixed | learnt
    out[:, 0], out[:, 1] = per(fixed, of) / n_words, np.log1p(per(fixed, of))
    out[:, 2], out[:, 3] = per(learnt, of) / n_words, np.log1p(per(learnt, of))
    out[:, 4], out[:, 5] = per(bad & near, of) / n_words, per(second, of) / n_words
    out[:, 6] = per(_UPPER[slab.data]) / np.maximum(per(_LETTERS[slab.data]), 1)
    out[:, 7], out[:, 8] = per(slab.data == 0x21) / size, per(_SIGN[slab.data]) / size
    out[:, 9] = per(_DIGIT[slab.data]) / size
    signed = Slab(slab.first, slab.last, _LOOKALIKE[slab.data], slab.offsets)
    v, read = words(Slab(slab.first, slab.last, slab.data, slab.offsets), _SIGNED_WORD, lower=False)
    odd = np.concatenate(([0], np.cumsum(_DIGIT[slab.data] | _SIGN[slab.data])))
    letters = np.concatenate(([0], np.cumsum(_LETTERS[slab.data])))
    vof = np.repeat(np.arange(n), np.diff(v.offsets))
    inside = np.minimum(v.starts + 1, v.ends), np.maximum(v.ends - 1, v.starts)
    mixed = (odd[np.maximum(*inside)] - odd[inside[0]] > 0) & (letters[v.ends] - letters[v.starts] >= 2)
    if mixed.any():
        back = _among(span_hashes(signed.data, v.starts[mixed], v.ends[mixed]), known.lexicon)
        out[:, 11] = np.log1p(np.bincount(vof[mixed][back], minlength=n))
    out[:, 10] = per(mixed, vof) / n_words
    out[:, 12] = np.log1p(np.diff(w.offsets))
    out[:, 13] = per(bad, of) / n_words
    out[:, 14] = np.log1p(per(bad, of))
    return out


def _stem_rows(batches):
    """The distinct stems of each sampled text, and a name that near copies share: the least hash of its runs of three words."""
    for batch in batches:
        stems, name = [], []
        for slab in slabs(batch.column("text")):
            w, data = words(slab, WORD)
            h = span_hashes(data, w.starts, w.ends)
            raw = data.tobytes()
            grams, at = shingles(h, w.offsets, 3)
            for d in range(len(slab)):
                a, b = w.offsets[d], w.offsets[d + 1]
                stems.append(sorted({raw[s : s + k].hex() for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True) for k in STEM_BYTES if e - s >= k}))
                name.append(int(grams[at[d] : at[d + 1]].min().view(np.int64)) if b > a else 0)
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(name, pa.int64()), pa.array(stems, pa.list_(pa.string()))], names=["doc_id", "label", "name", "stems"])


def learn_stems(texts: DataFrame) -> dict[int, np.ndarray]:
    """Stems of which toxic texts, a fortieth of them at least, hold far more than their share, counting near copies once.

    Of stems that start alike the shortest that is as telling stays.
    """
    rows = texts.select("doc_id", "label", "text").mapInArrow(_stem_rows, "doc_id long, label int, name long, stems array<string>").groupBy("label", "name").agg(F.min_by("stems", "doc_id").alias("stems"))
    total = dict(rows.groupBy("label").count().collect())
    if set(total) < {0, 1}:
        return {k: np.zeros(0, np.uint64) for k in STEM_BYTES}
    counts = rows.select("label", F.explode("stems").alias("stem")).groupBy("stem").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
    good = F.col("all") - F.col("bad")
    odds = F.log((F.col("bad") + 0.1) / (total[1] + 0.2)) - F.log((good + 0.5) / (total[0] + 1.0))
    best = counts.where((F.col("bad") >= max(3, total[1] / 40)) & (good * total[1] * 25 <= F.col("bad") * total[0])).orderBy(F.desc(odds * F.sqrt("bad")), F.length("stem"), "stem").limit(STEMS)
    found: dict[int, list[str]] = {k: [] for k in STEM_BYTES}
    kept: list[str] = []
    for r in sorted(best.collect(), key=lambda r: len(r.stem)):
        if not any(r.stem.startswith(k) for k in kept):
            kept.append(r.stem)
            found[len(r.stem) // 2].append(r.stem)
    return {k: _hash_bytes([bytes.fromhex(s) for s in v]) for k, v in found.items()}


def _hash_bytes(some: list[bytes]) -> np.ndarray:
    if not some:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b"".join(some), np.uint8)
    ends = np.cumsum([len(s) for s in some])
    return np.unique(span_hashes(data, ends - np.array([len(s) for s in some]), ends))


def _feature_rows(known: Words):
    def run(batches):
        for batch in batches:
            blocks = [features(slab, known) for slab in slabs(batch.column("text"))]
            x = np.concatenate(blocks) if blocks else np.zeros((0, FEATURES))
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "_features"])

    return run


def with_features(docs: DataFrame, known: Words) -> DataFrame:
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(_feature_rows(known), f"{fields}_features array<double>").withColumn("_vector", array_to_vector("_features")).drop("_features")


@dataclass
class Model:
    known: Words
    trees: object
    curve: object
    frequency: float


def fit(docs: DataFrame, labels: DataFrame, learnt: Column, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` rows of ``labels`` for which ``learnt`` holds."""
    texts, frequency = labelled_sample(docs, labels, "toxic", learnt, sample)
    texts = texts.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4))).cache()
    known = Words(_hash_words(LEXICON), _hash_words(SECOND_PERSON), learn_stems(texts.where("fold <> 0")))
    rows = with_features(texts.select("label", "fold", "text"), known).drop("text").withColumn("label", F.col("label").cast("double")).cache()
    kinds = {(r.part, r.label): r["count"] for r in rows.groupBy((F.col("fold") == 0).alias("part"), "label").count().collect()}
    model = Model(known, None, None, frequency if kinds else 0.0)
    if all(kinds.get((part, v), 0) for part in (True, False) for v in (0.0, 1.0)):
        model.trees = GBTClassifier(featuresCol="_vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, seed=1).fit(rows.where("fold <> 0"))
        weight = F.when(F.col("label") == 1, frequency / kinds[(True, 1.0)]).otherwise((1 - frequency) / kinds[(True, 0.0)]) * 1000
        held = model.trees.transform(rows.where("fold = 0")).select("label", vector_to_array("rawPrediction")[1].alias("margin"), weight.alias("w"))
        model.curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="w").fit(held)
    rows.unpersist()
    texts.unpersist()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with _score; any columns stay."""
    if model.trees is None:
        return docs.withColumn("_score", F.lit(float(model.frequency)))
    out = model.trees.transform(with_features(docs, model.known)).withColumn("_margin", vector_to_array("rawPrediction")[1])
    out = model.curve.setFeaturesCol("_margin").setPredictionCol("_score").transform(out.drop("prediction", "probability", "rawPrediction"))
    return out.withColumn("_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_score"))).select(*[f"`{c}`" for c in docs.columns], "_score")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; learns from labels outside the held-out fold."""
    model = fit(docs, labels, ~held_out("doc_id", folds, fold), **how)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= TOXIC_AT).cast("int").alias("predicted"))
