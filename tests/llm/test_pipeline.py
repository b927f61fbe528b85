"""The pipeline's stages hold what their operators decide."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage."""
    from evidloom.llm.scratch import written

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after, _ = written(stage(spark, docs, sf_dir), name)
        out[name] = (docs, after)
        docs = after
    return out


def test_stages(spark, sf_dir, stages):
    from evidloom.llm import decontaminate, mixing, ngram_join, quality

    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    kept = list(stages.values())
    docs = kept[-1][1]
    assert all(after.columns == before.columns for before, after in kept[:-1])
    assert ids(kept[0][1]) == ids(quality.quality(kept[0][0], labels).where("predicted = 1"))
    assert ids(kept[1][1]) == ids(ngram_join.ngram_join(kept[1][0]).where("doc_id = component_id"))
    hit = decontaminate.contamination(kept[2][0], bench)
    assert ids(kept[2][1]) == ids(hit.where("n_hit <= 0.5 * n_words"))
    assert decontaminate.contamination(kept[2][1], bench).where("n_hit > 0").count() == 0
    taken = mixing.mixture(kept[3][0]).select("doc_id", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).alias("n"))
    counts = {r.doc_id: r["count"] for r in kept[3][1].groupBy("doc_id").count().collect()}
    assert all(counts.get(r.doc_id, 0) == r.n for r in taken.where("n IS NOT NULL").collect())
    assert ids(kept[4][1]) == ids(kept[3][1])
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(docs.collect())


def test_stages_by_brute_force(spark, sf_dir, stages):
    """Each stage on its own input against plain Python, DuckDB and the tokenizer itself."""
    import re
    import zlib
    from collections import Counter

    import duckdb
    import numpy as np
    from tokenizers import Tokenizer

    from evidloom.llm import quality, queries
    from tests.llm.test_llm import brute_quality

    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    kept = {name: (a.toPandas(), b.toPandas()) for name, (a, b) in stages.items()}

    before, after = kept["quality"]
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, "quality", ~quality.held_out("doc_id", 3, 1))
    sure = {i: s >= 0.5 for i, t in zip(before.doc_id, before.text, strict=True) if abs((s := brute_quality(model, t or "")) - 0.5) > 0.02}
    assert {i for i, good in sure.items() if good} == set(after.doc_id) & set(sure)

    before, after = kept["near_copies"]
    sets = {}
    for i, t in zip(before.doc_id, before.text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert sorted(after.doc_id) == [i for i in ids if top(i) == i]

    before, after = kept["decontaminate"]
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for t in bench.text:
        w = re.findall(word, low(t))
        windows |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9)) if w}
    left = {}
    for i, t in zip(before.doc_id, before.text, strict=True):
        spans = [m.span() for m in re.finditer(word, low(t))]
        w = [low(t)[a:b] for a, b in spans]
        hit = np.zeros(len(w), bool)
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                hit[k : k + size] |= tuple(w[k : k + size]) in windows
        if hit.sum() <= 0.5 * len(w):
            gone = np.zeros(len(t or ""), bool)
            for k, (a, b) in enumerate(spans):
                if hit[k]:
                    gone[a : spans[k + 1][0] if k + 1 < len(w) and hit[k + 1] else b] = True
            left[i] = "".join(c for c, g in zip(t or "", gone, strict=True) if not g)
    assert dict(zip(after.doc_id, after.text.fillna(""), strict=True)) == left

    before, after = kept["mix"]
    c = duckdb.connect()
    c.register("documents", before)
    want = {i: n // s for i, s, n in c.execute(f"SELECT doc_id, size, taken FROM ({queries.SQL['op4_pareto_mixture']})").fetchall() if n}
    assert Counter(after.doc_id) == want

    before, after = kept["token_store"]
    t = Tokenizer.from_file(queries.tokenizer_path())
    ids_of = [[*x.ids, 2] for x in t.encode_batch_fast(list(before.text.fillna("")), add_special_tokens=False)]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in zip(before.doc_id, ids_of, strict=True))
    assert Counter(zip(after.doc_id, after.n_tokens, after.ids_crc32, strict=True)) == want
    ordered = after.sort_values("start")
    assert ordered.doc_id.is_monotonic_increasing and list(ordered.start) == [0, *np.cumsum(ordered.n_tokens)[:-1]]


def test_stages_of_odd_rows(spark, sf_dir):
    """Nulls in any column, repeats, empty and long texts, and columns whose names operators use: rows go through or away whole."""
    from evidloom.llm.scratch import written

    schema = "doc_id long, text string, lang string, source string, n_chars long, cls string, _hit int, score double, copies int"
    rows = [(None, "some words without an id, but enough of them to be kept", "en", None, None, None, 1, None, 2), (1, None, None, "s", 0, "a", None, 1.0, None), (2, "", "en", None, 0, "b", 2, 2.0, 1), (3, "Good plain words that stand in order, one after another.", "en", "s", 9, None, None, None, None), (3, "Good plain words that stand in order, one after another.", "en", "s", 9, None, None, None, None), (4, "Long words and more of them. " * 4000, "en", "t", 1, "x", 0, 0.0, 0)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            out, _ = written(stage(spark, docs, sf_dir), f"odd-{name}")
            if name != "token_store":
                assert out.columns == docs.columns
            if not given:
                assert out.count() == 0
            docs = out
