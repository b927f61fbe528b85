"""The dictionary automaton against a direct search."""

from __future__ import annotations

import pickle
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark import cloudpickle

from evidloom.operators import dictionary, matching

words = st.lists(st.integers(0, 3), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=5).map(tuple), min_size=1, max_size=15, unique=True), st.lists(words, min_size=1, max_size=4), st.sampled_from([2, 7, 256]))
def test_automaton(patterns, texts, step):
    flat, offsets = np.array([x for t in texts for x in t], np.int64) * 7919, np.append(0, np.cumsum([len(t) for t in texts]))
    old, dictionary.STEP = dictionary.STEP, step
    try:
        got = sorted(zip(*[x.tolist() for x in dictionary.Automaton([np.array(p) * 7919 for p in patterns]).matches(flat, offsets)], strict=True))
    finally:
        dictionary.STEP = old
    assert got == sorted((d, i, s) for d, t in enumerate(texts) for i, p in enumerate(patterns) for s in range(len(t) - len(p) + 1) if tuple(t[s : s + len(p)]) == p)


def by_hand(rows, names):
    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    patterns = {}
    for n in names:
        if split(n):
            patterns[tuple(split(n))] = min(n, patterns.get(tuple(split(n)), n))
    found = {}
    for key, t in rows:
        w = split(t)
        for p, name in patterns.items():
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hits, first = found.get((key, name), (0, s))
                    found[key, name] = hits + 1, min(first, s)
    return found


def test_matches_over_blocks(spark, monkeypatch):
    names = ["data", "Data science", "science of", "of", "machine learning", "learning", "machine  Learning", "c", "a b a", "b a b", "", "!!", "x" * 200, None]
    rows = [(1, "Data science of data, of machine learning"), (1, "data"), (2, "a b a b a " * 400), (3, None), (4, ""), (None, "machine-learning data"), (5, "x" * 200), (6, "nothing")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS name", "2 AS _words", "3 AS hits").repartition(3)
    for block in (200_000, 5):
        monkeypatch.setattr(dictionary, "BLOCK", block)
        blocks = dictionary.automata(spark.createDataFrame([(n,) for n in names], "alias string"), "alias")
        assert (blocks.count() > 1) == (block == 5)
        got = dictionary.dictionary_matches(texts.drop("_words", "name"), blocks, "text", ["doc_id"]).collect()
        assert {(r.doc_id, r["name"]): (r.hits, r.first_at) for r in got} == by_hand(rows, names)
    empty = spark.createDataFrame([], "alias string")
    assert matching.alias_matches(texts.drop("_words", "name"), empty, "text", "alias", ["doc_id"]).count() == 0


def test_a_batch_runs_in_pieces(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(dictionary, "PIECE", 50)
    names = spark.createDataFrame([("a",), ("a b",), ("b a b",)], "alias string")
    rows = [(i, "a b " * (i % 7)) for i in range(40)] + [(40, "a b " * 100), (41, None), (42, "c " * 60)]
    blocks = dictionary.automata(names, "alias")
    of = blocks.collect()
    told = spark.createDataFrame([(r.block, r.names, cloudpickle.dumps(_told(pickle.loads(r.automaton), str(tmp_path / "seen")))) for r in of], blocks.schema)
    got = dictionary.dictionary_matches(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), told, "text", ["doc_id"]).collect()
    assert {(r.doc_id, r["name"]): (r.hits, r.first_at) for r in got} == by_hand(rows, ["a", "a b", "b a b"])
    sizes = [tuple(map(int, line.split())) for line in (tmp_path / "seen").read_text().splitlines()]
    assert len(sizes) > 5 and all(n <= 50 or texts == 1 for n, texts in sizes) and sum(t for _, t in sizes) == len(rows)


def _told(automaton, path):
    """An automaton that writes down how many words and texts it is given at a time."""

    class Told:
        def matches(self, hashes, offsets):
            with open(path, "a") as f:
                f.write(f"{len(hashes)} {len(offsets) - 1}\n")
            return automaton.matches(hashes, offsets)

    return Told()
