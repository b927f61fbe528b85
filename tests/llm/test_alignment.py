"""Token alignment against a direct one of each text, encoded by the libraries as they are."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from evidloom.llm import alignment, queries

PATHS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*PATHS)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    back = {}  # printable stand-ins of bytes
    for b in range(256):
        back[chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE else chr(0x100 + sum(not (0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or x >= 0xAE) for x in range(b)))] = b
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), back


def by_hand(libraries, text):
    """(ids of A, ids of B, groups as text, linked pairs) of a text, or None where it has no tokens."""
    a, b, back = libraries
    if not text:
        return None
    whole, got = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(back[c] for c in t)) for i, t in zip(got.ids, got.tokens, strict=True)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return None
    groups, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
    while i < len(left):
        mine, other = [left[i]], []
        at_a, i = at_a + len(left[i][1]), i + 1
        while at_a != at_b:
            if at_a < at_b:
                mine.append(left[i])
                at_a, i = at_a + len(left[i][1]), i + 1
            else:
                other.append(right[j])
                at_b, j = at_b + len(right[j][1]), j + 1
        groups.append(",".join(str(x) for x, _ in mine) + "|" + ",".join(str(x) for x, _ in other))
        links.append((mine[-1][0], other[-1][0]))
    return [x for x, _ in left], [x for x, _ in right], ";".join(groups), links


ODD = [
    None, "", " ", "  ", "a ", "a  ", "▁a", "a b▁ c", "<|endoftext|> <s> </s><unk><0x41>", "\n\n x\n y\t z \n", "  a  b\x1c c\x85 d", "中文 日本  한국어",
    "é è ж \U0001f600 \U0001f44d\U0001f3fd", "a\x00b \x00", "x" * 30_000, "' 's 't  '' 's", "trail \n ", "don't  stop   it's", "a  b　 c  d",
]


def check(aligner, libraries, texts):
    k = 0
    for first, counts, shown, offsets, codes in aligner.documents(pa.array(texts, pa.string())):
        for d in range(len(counts)):
            want = by_hand(libraries, texts[first + d])
            mine = codes[offsets[d] : offsets[d + 1]].tolist()
            if want is None:
                assert (*counts[d].tolist(), shown[d], mine) == (0, 0, 0, b"", [])
            else:
                assert counts[d].tolist() == [len(want[0]), len(want[1]), len(want[3])] and shown[d].decode() == want[2]
                assert mine == [x * aligner.size_b + y for x, y in want[3]]
            k += 1
    assert k == len(texts)


def test_odd_texts(aligner, libraries):
    assert aligner.cuts
    check(aligner, libraries, ODD)
    check(aligner, libraries, ODD)  # from the cache


@settings(max_examples=120, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*" \n\t'ab9.!é中▁\u00a0", "the ", " is", "  "]), max_size=25).map("".join), min_size=1, max_size=5))
def test_random_texts(aligner, libraries, texts):
    check(aligner, libraries, texts)


def test_forgotten_stretches(aligner, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED", 60)
    for k in range(6):
        check(aligner, libraries, [f"word{i} again{i % 7} x" for i in range(10 * k, 10 * k + 30)])
    assert len(aligner.keys) < 200 and len(aligner.keys) == len(aligner.row)


def test_texts_whole_where_tokenizers_join_over_spaces(aligner, libraries):
    whole = alignment.Aligner(*PATHS)
    whole.cuts = False
    check(whole, libraries, ODD)


def test_components():
    u, v = np.array([0, 1, 4, 5, 7, 8]), np.array([9, 9, 5, 6, 8, 2])
    assert alignment.components(10, u, v).tolist() == [0, 0, 2, 3, 4, 4, 4, 2, 2, 0]
    n = 5000
    assert not alignment.components(n, np.arange(n - 1), np.arange(1, n)).any()


def rows_by_hand(libraries, rows):
    own = [(d, by_hand(libraries, t)) for d, t in rows]
    counts = Counter(link for _, x in own if x for link in x[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for d, x in own:
        if x is None:
            yield d, 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, shown, links = x
            yield d, len(a), len(b), len(links), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(shown.encode()).hexdigest()


def listed(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_query(spark, sf_dir, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert listed(queries.QUERIES["op11_token_alignment"](spark, sf_dir)) == sorted(rows_by_hand(libraries, rows), key=str)


def test_odd_rows(spark, libraries):
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate([*ODD, "same text", "same text"])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").selectExpr("*", "1 AS kind", "2 AS codes", "'x' AS n_links").repartition(3)
    got = alignment.alignment(docs, *PATHS, whole=True)
    assert listed(got.documents) == sorted(rows_by_hand(libraries, rows), key=str)
    assert {r.groups for r in got.documents.collect()} == {"" if x is None else x[2] for x in (by_hand(libraries, t) for _, t in rows)}
    counts = Counter(link for _, t in rows if (x := by_hand(libraries, t)) for link in x[3])
    assert {(r.a_id, r.b_id): r.links for r in got.pairs.collect()} == counts
    assert alignment.alignment(docs.where("false"), *PATHS).documents.count() == 0
