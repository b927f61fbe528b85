"""Classes that cannot link leave the n-gram join before their prefixes are sent."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from evidloom.llm import ngram_join
from evidloom.llm.scratch import remove


def test_similar_sets_share_enough_of_what_is_sent():
    rng = random.Random(4)
    for percent in (75, 60):
        for _ in range(3000):
            n = rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 33, 60])
            a = {rng.getrandbits(64) for _ in range(n)}
            b = set(rng.sample(sorted(a), rng.randint(max(1, percent * n // 100), n))) | {rng.getrandbits(64) for _ in range(rng.randint(0, n // 3))}
            if 100 * len(a & b) < percent * len(a | b):
                continue
            first = [set(sorted(x)[: ngram_join.sent(len(x), percent)]) for x in (a, b)]
            assert len(first[0] & first[1]) >= max(ngram_join.least_shared(len(x), percent) for x in (a, b))


def test_classes_without_likeness_send_no_prefix(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3000)  # several blocks a task
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = [text(rng.randint(5, 120)) for _ in range(400)]
    near = {rng.randrange(400) for _ in range(12)}
    rows += [[*rows[i], "more"] for i in sorted(near)]
    df = spark.createDataFrame([(i if i % 7 else None, " ".join(x)) for i, x in enumerate(rows)] + [(1000, None), (1001, "")], "doc_id long, text string").repartition(3)
    join = ngram_join._Join(df, 5, 75)
    comp = {x.node: x.component for x in join.components().collect()}
    cls = [ngram_join.class_of(np.array(x, np.uint64)) for x in (next(iter(ngram_join.sets_of(pa.array([" ".join(r)]), 5))) for r in rows)]
    sets = [{tuple(r[k : k + 5]) for k in range(max(1, len(r) - 4))} for r in rows]
    linked = {(i, k) for k in range(400, len(rows)) for i in range(k) if 100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k])}
    assert len(linked) > 8 and {frozenset((cls[i], cls[k])) for i, k in linked} == {frozenset((x, c)) for x, c in comp.items() if x != c}
    assert join.classes.count() <= 3 * len(near)
    remove(spark, *join.paths)
