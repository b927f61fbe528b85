"""Periodic runs against a direct search of each period."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from evidloom.llm import queries
from evidloom.llm.periodic import maximal_runs, periodic_runs


def runs_by_hand(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """Each period in turn: stretches of words that equal those a period on; a stretch belongs to its smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)  # periods ascend
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed_by_hand(words: list[str], runs) -> str:
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def row_by_hand(words: list[str]) -> tuple:
    runs = runs_by_hand(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    text = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (text, collapsed_by_hand(words, runs))))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), min_size=1, max_size=4), st.sampled_from([2, 4, 12]))
def test_runs_of_random_words(docs, least):
    codes = np.array([x for d in docs for x in d], np.uint64)
    got = maximal_runs(codes, np.append(0, np.cumsum([len(d) for d in docs])), least)
    assert got.tolist() == [[d, *r] for d, words in enumerate(docs) for r in runs_by_hand(words, least)]


@pytest.mark.parametrize("words", [["a"] * 40, list("ab") * 6, list("abcde") * 2 + ["a", "b"], list("abaab") * 7 + list("xyxyxyxyxyxyx") + list("abaab") * 3, [str(i) for i in range(40)] * 2, list("aab" * 9 + "aac" * 9)])
def test_runs_of_known_words(words):
    got = maximal_runs(np.array([zlib.crc32(w.encode()) for w in words], np.uint64), np.array([0, len(words)]))
    assert [tuple(r) for r in got[:, 1:].tolist()] == runs_by_hand(words)


def test_query(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) <= 1500:
            assert got[d] == row_by_hand(w), d
            some += got[d][0] > 0
    assert some > 5


def test_odd_rows(spark):
    long = " ".join(["so", "it", "goes"] * 20_000)
    rows = [(None, None, 1), (1, None, 1), (2, "", 1), (3, " \n\t ", 1), (4, "a " * 12, 1), (4, "a " * 12, 1), (5, "a " * 11, 2), (6, long, 1), (7, "é\u00a0ü " * 13, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int").selectExpr("*", "1 AS period", "'x' AS runs")
    got = sorted(periodic_runs(docs, whole=True).collect(), key=lambda r: (r.doc_id or 0, r.collapsed))
    assert [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in got] == [
        (None, 0, *[None] * 4), (1, 0, *[None] * 4), (2, 0, *[None] * 4), (3, 0, *[None] * 4), (4, 1, 0, 12, 1, 12_000), (4, 1, 0, 12, 1, 12_000),
        (5, 0, *[None] * 4), (6, 1, 0, 60_000, 3, 20_000_000), (7, 1, 0, 13, 1, 13_000),
    ]
    assert [r.collapsed for r in got] == ["", "", "", "", "a", "a", " ".join("a" * 11), "so it goes", "é\u00a0ü"]
    assert [tuple(x) for x in got[7].runs] == [(0, 60_000, 3)]
    assert periodic_runs(docs.where("false")).count() == 0
