"""Two tokenizers' tokens of one text aligned in minimal groups, and how often ids are linked.

Tokens are byte ranges. The tokens of both sides are the nodes of a bipartite graph whose edges join
ranges that overlap; its connected components, found by union-find, are the smallest groups of tokens
of one side that cover the same bytes as a group of the other. Within a component, an A and a B token
that end at the same byte are linked. Links are counted a pair of ids in each task, then summed by pair
over all documents, and each document looks up the sums of its own links.

Neither tokenizer joins anything over a space that follows another character (tried out, and read off
the vocabulary, as they are loaded; texts are taken whole otherwise). Both thus end a token there, no
component reaches over, and a stretch between two such places is encoded and aligned once for all
places where it stands. A bounded cache keeps the stretches a worker has met. Stretches are told
apart by 64-bit hashes. A text that holds a stretch whose tokens do not spell it is encoded whole.

``A`` is a byte-level file of the tokenizers library, ``B`` a sentencepiece model that puts a space
before a text; A gets the text with that space. Special tokens' strings are plain text.

A null or empty text, and one that A's or B's tokens do not spell, has no tokens: zeros and ''. Each of
repeated rows is a document and counts. Null ids stay. Only id and text are read, so other columns may
have any names. An empty table gives none. Memory follows a slab of text or the longest document.

Linked ids end with the same bytes, so the shorter is a suffix of the longer; there are no more such
pairs than the bytes of all tokens of both vocabularies, and that bounds the table of counts which is
broadcast (about half a million rows of 17 bytes for two vocabularies of 50,000 and 32,000).
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evidloom.llm.scratch import small_batches, written
from evidloom.llm.textvec import slabs, span_hashes, tidy

_U = np.uint64
CACHED = 500_000  # stretches that a worker keeps
_MARK = "▁"


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... (counts[k] of them) for each k, one after the other."""
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(int(counts.sum()))


class Pool:
    """Byte strings one after the other."""

    def __init__(self, strings: list[bytes]):
        self.n = np.array([len(s) for s in strings], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        return self.data[spread(self.at[which], self.n[which])]


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over edges (u, v) of n nodes: the least node of each node's component. Roots hook to lesser roots, then paths are halved until flat."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return parent
        u, v, low, high = u[apart], v[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


@dataclass
class Aligned:
    """Of each text: tokens, groups, whether its tokens spell it, the groups as text, and its links (offsets into codes)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    spelt: np.ndarray
    shown: list[bytes]
    offsets: np.ndarray
    codes: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = byte_level_alphabet(), self.a.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            names[i] = piece
        self.bytes_a = Pool([bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Pool([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_MARK, " ").encode() for i, x in enumerate(pieces)])
        self.size_b = len(pieces)
        self.most_pairs = int(self.bytes_a.n.sum() + self.bytes_b.n.sum())
        self.kind = "int" if len(names) * self.size_b < 1 << 31 else "long"
        self.digits = Pool([str(i).encode() for i in range(max(len(names), self.size_b))])
        self.lone = self.b.encode("x ")[len(self.b.encode("x")) :]  # a single space at the end of a text
        self.cuts = not any(_MARK in x.lstrip(_MARK) for x in pieces) and self._cuts_at_spaces()
        self.forget(np.zeros(0, bool))

    def _cuts_at_spaces(self) -> bool:
        for c in [chr(i) for i in range(0x21, 0x7F)] + ["é", "Ж", "中"]:
            parts = [f" x{c}", f"  y{c}", " z"]
            if [x[0].tolist() for x in self._ids(parts)] != [x[0].tolist() for x in self._ids(["".join(parts)])]:
                return False
        return True

    def forget(self, keep: np.ndarray) -> None:
        """Empties the cache but for ``keep``."""
        if not len(keep):
            self.keys, self.row, self.used = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, bool)
            self.table, self.shown, self.codes = np.zeros((0, 6), np.int64), [], np.zeros(0, np.int64)
            return
        kept = self.row[keep]
        table = self.table[kept]
        self.codes = self.codes[spread(table[:, 4], table[:, 5])]
        table[:, 4] = np.cumsum(table[:, 5]) - table[:, 5]
        self.shown = [self.shown[k] for k in kept.tolist()]
        self.keys, self.table, self.row, self.used = self.keys[keep], table, np.arange(len(table)), np.zeros(len(table), bool)

    def _ids(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A's and B's ids of texts that start with a space each, one after the other, and how many each has."""
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [self.lone if t == " " else x for t, x in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]
        return tuple((np.fromiter(chain.from_iterable(x), np.int64), np.fromiter(map(len, x), np.int64, len(x))) for x in (a, b))

    def _ids_of_stretches(self, texts: list[str]):
        """The same where A gets many stretches at once: as they follow each other in a text, if none ends in what may be white space."""
        sure = [len(t) > 1 and "!" <= t[-1] <= "~" for t in texts]
        joined, own = [t for t, x in zip(texts, sure, strict=True) if x], [t for t, x in zip(texts, sure, strict=True) if not x]
        flat = np.fromiter(chain.from_iterable(x.ids for x in self.a.encode_batch_fast(["".join(joined[k : k + 2000]) for k in range(0, len(joined), 2000)], add_special_tokens=False)), np.int64)
        size = np.fromiter((len(t.encode()) for t in joined), np.int64, len(joined))
        end = np.cumsum(self.bytes_a.n[flat])
        at = np.searchsorted(end, np.cumsum(size))
        if len(joined) and not (end[-1] == size.sum() and np.array_equal(end[at], np.cumsum(size))):
            return self._ids(texts)
        rest = [x.ids for x in self.a.encode_batch_fast(own, add_special_tokens=False)]
        count = np.empty(len(texts), np.int64)
        sure = np.array(sure, bool)
        count[sure], count[~sure] = np.diff(at, prepend=-1), [len(x) for x in rest]
        ids, of = np.empty(int(count.sum()), np.int64), np.repeat(sure, count)
        ids[of], ids[~of] = flat, np.fromiter(chain.from_iterable(rest), np.int64)
        b = [self.lone if t == " " else x for t, x in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]
        return (ids, count), (np.fromiter(chain.from_iterable(b), np.int64), np.fromiter(map(len, b), np.int64, len(b)))

    def align(self, texts: list[bytes], stretches: bool = False) -> Aligned:
        n = len(texts)
        ids = (self._ids_of_stretches if stretches and self.cuts else self._ids)([t.decode() for t in texts])
        size, whole = np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)
        sides = []
        for (flat, count), pool in zip(ids, (self.bytes_a, self.bytes_b), strict=True):
            of = np.repeat(np.arange(n), count)
            length = pool.n[flat]
            right = np.bincount(of, length, n).astype(np.int64) == size
            fits = np.repeat(right, size)
            wrong = pool.joined(flat[right[of]]) != whole[fits]
            right[np.repeat(np.arange(n), size)[fits][wrong]] = False
            sides.append((flat, of, length, right))
        spelt = sides[0][3] & sides[1][3] & (size > 0)
        (a, of_a, start_a, end_a, n_a), (b, of_b, start_b, end_b, n_b) = (self._ranges(*side[:3], spelt, size) for side in sides)
        # Overlapping ranges are edges; components are groups.
        first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        root = components(len(a) + len(b), np.repeat(np.arange(len(a)), last - first), len(a) + spread(first, last - first))
        leads = root[: len(a)] == np.arange(len(a))
        group = np.cumsum(leads) - 1
        group_a, group_b = group, group[root[len(a) :]]
        # Members of a component that end together are linked.
        at = np.minimum(np.searchsorted(end_b, end_a), max(len(b) - 1, 0))
        linked = np.flatnonzero((end_b[at] == end_a) & (group_b[at] == group_a)) if len(b) else np.zeros(0, np.int64)
        codes, of_link = a[linked] * self.size_b + b[at[linked]], of_a[linked]
        return Aligned(
            n_a, n_b, np.bincount(of_a[leads], minlength=n), spelt, self._shown(a, b, group_a, group_b, of_a[leads], n),
            np.searchsorted(of_link, np.arange(n + 1)), codes,
        )

    @staticmethod
    def _ranges(flat: np.ndarray, of: np.ndarray, length: np.ndarray, spelt: np.ndarray, size: np.ndarray):
        """Tokens of the texts that are spelt, with their ranges in these texts one after the other."""
        mine = spelt[of]
        flat, of, length = flat[mine], of[mine], length[mine]
        end = np.cumsum(length)
        return flat, of, end - length, end, np.bincount(of, minlength=len(spelt))

    def _shown(self, a, b, group_a, group_b, of_group, n: int) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        groups = len(of_group)
        many_a, many_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(many_a)[group_b]
        ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        sign[place_a[np.cumsum(many_a) - 1]] = ord("|")
        sign[place_b[np.cumsum(many_b) - 1]] = ord(";")
        end = np.cumsum(self.digits.n[ids] + 1)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        into = np.ones(len(out), bool)
        into[end - 1] = False
        out[into], out[end - 1] = self.digits.joined(ids), sign
        # The last sign of each text is left out.
        stop = np.zeros(n, np.int64)
        stop[of_group] = end[place_b[np.cumsum(many_b) - 1]]
        raw, stop = out.tobytes(), np.maximum.accumulate(stop).tolist()
        return [raw[x : y - 1] if y > x else b"" for x, y in zip([0, *stop[:-1]], stop, strict=True)]

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """Adds stretches, whose keys ascend."""
        new = self.align(texts, stretches=True)
        rows = np.stack((new.n_a, new.n_b, new.n_groups, new.spelt, len(self.codes) + new.offsets[:-1], np.diff(new.offsets)), 1)
        into = np.searchsorted(self.keys, keys)
        self.row = np.insert(self.row, into, len(self.table) + np.arange(len(keys)))
        self.keys, self.used = np.insert(self.keys, into, keys), np.insert(self.used, into, False)
        self.table, self.codes = np.concatenate((self.table, rows)), np.concatenate((self.codes, new.codes))
        self.shown += new.shown

    def documents(self, column):
        """For each slab of texts: (first document, counts [n_a, n_b, n_groups] a document, digests of groups, groups as text, offsets and codes of links)."""
        for slab in slabs(column, 1 << 20, 2048):
            full = np.diff(slab.offsets) > 0
            # A space before each text that is not empty.
            offsets = np.append(0, np.cumsum(np.diff(slab.offsets) + full))
            data = np.full(int(offsets[-1]), 0x20, np.uint8)
            data[spread(offsets[:-1] + full, np.diff(slab.offsets))] = slab.data
            starts = self._starts(data, offsets)
            ends = np.append(starts[1:], len(data))
            which, keys = pd.factorize(span_hashes(data, starts, ends))
            order = np.argsort(keys)
            first = np.empty(len(keys), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            keys, first, back = keys[order], first[order], np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            if len(self.keys) + len(keys) > CACHED:
                self.forget(self.used if 2 * int(self.used.sum()) < CACHED else np.zeros(0, bool))
            at = np.searchsorted(self.keys, keys)
            missing = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
            raw = data.tobytes()
            known = np.setdiff1d(np.arange(len(keys)), missing, assume_unique=True)
            if len(self.keys):
                self.used[at[known]] = True
            if len(missing):
                self._learn(keys[missing], [raw[x:y] for x, y in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist(), strict=True)])
                at = np.searchsorted(self.keys, keys)
            unit = self.row[at[back][which]]
            bound = np.searchsorted(starts, offsets)
            yield slab.first, *self._summed(unit, bound, raw, offsets)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where stretches start: at texts, and at spaces after a character that is surely no white space."""
        start = np.zeros(len(data), bool)
        if self.cuts and len(data) > 3:
            before = data[:-1]
            safe = (before > 0x20) & (before < 0x7F)
            lead = np.concatenate(([0], data[:-2]))
            safe |= (before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)
            lead = np.concatenate(([0, 0], data[:-3]))
            safe |= (before >= 0x80) & (lead >= 0xE4) & (lead <= 0xEC)
            start[1:] = safe & (data[1:] == 0x20)
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(start)

    def _summed(self, unit: np.ndarray, bound: np.ndarray, raw: bytes, offsets: np.ndarray):
        rows = self.table[unit]
        sums = np.concatenate((np.zeros((1, 6), np.int64), np.cumsum(rows, 0)))[bound]
        sums = np.diff(sums, axis=0)
        codes, links = self.codes[spread(rows[:, 4], rows[:, 5])], sums[:, 5].copy()
        shown, units = [], unit.tolist()
        for x, y in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            shown.append(b";".join([self.shown[k] for k in units[x:y]]))
        odd = np.flatnonzero(sums[:, 3] < np.diff(bound))
        if len(odd):  # some stretch is not spelt
            parts = np.split(codes, np.cumsum(links)[:-1])
            for d in odd.tolist():
                own = self.align([raw[offsets[d] : offsets[d + 1]]])
                sums[d, :3], shown[d], parts[d] = (own.n_a[0], own.n_b[0], own.n_groups[0]), own.shown[0], own.codes
            links, codes = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        return sums[:, :3], shown, np.append(0, np.cumsum(links)), codes


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    return _aligners.get(paths) or _aligners.setdefault(paths, Aligner(*paths))


def _encoded(paths: tuple[str, str], whole: bool, doc_type: pa.DataType, code_type: pa.DataType):
    """Rows of kind 'document', and at the end of a task rows of kind 'pair': its sums."""
    names = ["kind", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "codes", "code", "n"]
    types = [pa.string(), doc_type, *[pa.int64()] * 3, pa.string(), pa.string(), pa.list_(code_type), code_type, pa.int64()]

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(size, t) for k, t in zip(names, types, strict=True)], names)

    def run(batches):
        aligner = _aligner(paths)
        pairs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for first, counts, shown, offsets, codes in aligner.documents(batch.column(1)):
                n = len(counts)
                yield rows(
                    n, kind=pa.array(["document"] * n), doc_id=batch.column(0).slice(first, n),
                    **{k: pa.array(counts[:, i]) for i, k in enumerate(("n_a", "n_b", "n_groups"))},
                    groups_sha256=pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in shown]),
                    codes=pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(codes, code_type)),
                    **({"groups": pa.array([x.decode() for x in shown])} if whole else {}),
                )
                own, n = np.unique(codes, return_counts=True)
                pairs, back = np.unique(np.concatenate((pairs, own)), return_inverse=True)
                sums = np.bincount(back, np.concatenate((sums, n)), len(pairs)).astype(np.int64)
        if len(pairs):
            yield rows(len(pairs), kind=pa.array(["pair"] * len(pairs)), code=pa.array(pairs), n=pa.array(sums))

    return tidy(run)


def _looked_up(table):
    def run(batches):
        codes, counts, best = table.value
        for batch in batches:
            own = batch.column("codes")
            flat = own.flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(codes, flat)
            ends = np.append(0, np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False)))
            total = np.append(0, np.cumsum(counts[at]))[ends] if len(flat) else np.zeros(len(ends), np.int64)
            most = np.append(0, np.cumsum(best[at], dtype=np.int64))[ends] if len(flat) else np.zeros(len(ends), np.int64)
            kept = [c for c in batch.schema.names if c != "codes"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.diff(ends).astype(np.int64)), pa.array(np.diff(most)), pa.array(np.diff(total))], [*kept, "n_links", "n_best", "count_sum"])

    return tidy(run)


@dataclass
class Alignment:
    documents: DataFrame  # doc_id, n_a, n_b, n_groups, groups_sha256 (, groups), n_links, n_best, count_sum
    pairs: DataFrame  # a_id, b_id, links, best: whether no id of A has more links with the B id


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> Alignment:
    """Aligns every text; ``whole`` keeps the groups as text beside their digest.

    Texts are encoded once; what is written are counts and links of documents and each task's sums of pairs. Sums are shuffled
    by pair, pre-aggregated. The counts come back to documents as a broadcast table of bounded size (above; checked).
    """
    spark = docs.sparkSession
    small_batches(spark)
    paths = (path_a, path_b)
    aligner = _aligner(paths)
    kind, doc_kind = aligner.kind, dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    code_type = pa.int32() if kind == "int" else pa.int64()
    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = to_arrow_type(rows.schema["doc_id"].dataType)
    schema = f"kind string, doc_id {doc_kind}, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, codes array<{kind}>, code {kind}, n long"
    kept, _ = written(rows.mapInArrow(_encoded(paths, whole, doc_type, code_type), schema), "alignment", partition_by=["kind"])
    sums = kept.where("kind = 'pair'").groupBy("code").agg(F.sum("n").alias("links"))
    to = Window.partitionBy("b_id")
    pairs, _ = written(
        sums.selectExpr("code", f"CAST(code DIV {aligner.size_b} AS int) AS a_id", f"CAST(code % {aligner.size_b} AS int) AS b_id", "links").withColumn("best", F.col("links") == F.max("links").over(to)), "pairs"
    )
    bounded = pairs.select("code", "links", "best").limit(aligner.most_pairs + 1).toPandas().sort_values("code")
    if len(bounded) > aligner.most_pairs:
        raise RuntimeError("more linked pairs than suffixes of the vocabularies' tokens")
    table = spark.sparkContext.broadcast((bounded["code"].to_numpy(np.int64), bounded["links"].to_numpy(np.int64), bounded["best"].to_numpy(bool)))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *(["groups"] if whole else [])]
    found = kept.where("kind = 'document'").select(*columns, "codes")
    schema = f"doc_id {doc_kind}, n_a long, n_b long, n_groups long, groups_sha256 string, {'groups string, ' if whole else ''}n_links long, n_best long, count_sum long"
    return Alignment(found.mapInArrow(_looked_up(table), schema), pairs.drop("code"))
