"""Token ids in a content-addressed store.

Each document's ids, with an end id, are cut into chunks where a rolling hash of the last
``ROLL`` ids says so; equal passages of any documents therefore give equal chunks. A chunk is
named by the digest of its ids and stored once. A document's recipe lists its chunks. The store
is a folder of Parquet tables:

``data/kind=chunk``   digest, n, ids (unsigned little-endian integers of the store's width)
``data/kind=recipe``  one row a document: row (its name in the store), doc_id, n_tokens, digests,
                      lengths, root (of the Merkle tree over its digests)
``index``             the recipes in ascending doc_id order, a file a range, each with its start
                      within the range; then one manifest row a range: its documents and ids,
                      and the root of the Merkle tree over its documents' leaves (doc_id, ids
                      and root of each)
``manifest``          one row: the number of ranges, documents and ids, and the root of the Merkle
                      tree over the ranges

Tokens are looked up by word in a bounded cache, so the tokenizer sees each distinct word of a
worker about once; texts are cut only where the tokenizer's own pattern always cuts, which is
tried out as it is loaded: texts are encoded whole by one that cuts otherwise. Words are told
apart by 64-bit hashes: two of a slab have the same with probability 2**-64.

Only chunks that a task has not sent yet are shuffled, by digest, and once. Reading back first
recomputes count and root of each range over its ordered recipes and compares them with the
manifests (a row a range comes to the driver); then it checks every chunk against its name and
every recipe against its root and chunks, and combines the checksums of chunks into those of
documents, so no ids are moved again.

A null text is encoded as the empty one. Every document has at least the end id. Repeated rows
are separate documents of the store, which share all chunks. A null doc_id sorts first.
"""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from evidloom.llm.scratch import new_path, small_batches
from evidloom.llm.textvec import LOWER, give_back, mix, slabs, span_hashes, tidy

_U = np.uint64
ROLL, LEAST, MOST, MEAN = 16, 128, 2048, 512
CACHED = 2_000_000  # words of which a worker holds the ids, and
SENT = 50_000  # chunks that a task remembers to have sent
DIGEST = 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII that is neither letter nor space; the apostrophe may belong to a contraction.
_SIGN = ~_SPACE & ~_LETTER
_SIGN[0x80:] = False
_SIGN[0x27] = False
_LATIN = np.zeros(256, bool)
_LATIN[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True  # second bytes; the others are signs of arithmetic
_CODES = mix(np.arange(1, (1 << 20) + 1, dtype=_U))  # of ids; larger vocabularies are refused


class Encoder:
    """Ids of documents by a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.full = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.full.get_added_tokens_decoder().values()]
        self.size = self.full.get_vocab_size(with_added_tokens=True)
        self.folds = '"Lowercase"' in self.full.to_str()  # then words differing in case only have equal ids
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([normalizers.Lowercase()] if self.folds else [])
        ends = np.zeros(max(self.full.get_vocab(with_added_tokens=True).values()) + 1, bool)
        for piece, i in self.full.get_vocab(with_added_tokens=True).items():
            ends[i] = piece.endswith("</w>")
        self.ends = ends
        if len(ends) > len(_CODES):
            raise ValueError(f"vocabularies of more than {len(_CODES)} ids are not supported")
        self.odd = not self._cuts_as_assumed()
        self._clear()

    def _cuts_as_assumed(self) -> bool:
        """Whether the tokenizer never joins ASCII letters with signs, or anything over a space."""
        ids = lambda text: self.full.encode(text, add_special_tokens=False).ids
        signs = [chr(i) for i in np.flatnonzero(_SIGN)]
        a, b = ids("a"), ids("b")
        return all(ids(f"a{s}b") == [*a, *ids(s), *b] for s in signs) and ids("a b\na") == [*a, *b, *a]

    def _clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, _U), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Adds the ids of words, whose ``keys`` ascend; those of letters only are encoded in one text and told apart by their ends."""
        size = ends - starts
        n, at = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
        rest = np.ones(len(keys), bool)
        # ASCII letters, and the letters from U+00C0 to U+00FF (in two bytes), which are in normal form whatever stands beside them.
        lead = (data == 0xC3) & _LATIN[np.append(data[1:], 0)]
        count = np.concatenate(([0], np.cumsum(_LETTER[data] | lead | np.concatenate(([False], lead[:-1])))))
        letters = np.flatnonzero(count[ends] - count[starts] == size)
        if len(letters):
            own = size[letters] + 1  # a space follows each
            begin = np.cumsum(own) - own
            text = np.full(int(own.sum()), 0x20, np.uint8)
            step = np.arange(len(text)) - np.repeat(begin, own)
            inside = step < np.repeat(own - 1, own)
            text[inside] = data[(np.repeat(starts[letters], own) + step)[inside]]
            flat = np.array(self.plain.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(self.ends[flat]) + 1
            if len(cut) == len(letters):
                first = np.concatenate(([0], cut[:-1]))
                n[letters], at[letters] = cut - first, len(self.pool) + first
                self.pool = np.concatenate([self.pool, flat])
                rest[letters] = False
        left = np.flatnonzero(rest)
        if len(left):
            ids = [e.ids for e in self.full.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(starts[left].tolist(), ends[left].tolist(), strict=True)], add_special_tokens=False)]
            n[left] = [len(x) for x in ids]
            at[left] = len(self.pool) + np.cumsum(n[left]) - n[left]
            self.pool = np.concatenate([self.pool, np.array([i for x in ids for i in x], np.int32)])
        into = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, into, keys), np.insert(self.at, into, at), np.insert(self.n, into, n)

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans that the tokenizer's pattern never joins: cut at spaces, and between ASCII letters and signs."""
        some = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        letter, sign = _LETTER[data], _SIGN[data]
        cut[1:-1] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        starts = np.flatnonzero(some & (cut[:-1] | np.concatenate(([True], ~some[:-1]))))
        ends = np.flatnonzero(some & (cut[1:] | np.concatenate((~some[1:], [True])))) + 1
        return starts, ends

    def documents(self, column, end_id: int):
        """(ids of the documents of a slab, one after the other and each with its end id, and where each ends)."""
        for slab in slabs(column, 1 << 20, 4096):
            starts, ends = self._cut(slab.data, slab.offsets) if len(slab.data) else (np.zeros(0, np.int64),) * 2
            which, keys = pd.factorize(span_hashes(LOWER[slab.data] if self.folds else slab.data, starts, ends))
            first = np.empty(len(keys), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            order = np.argsort(keys)
            keys, first = keys[order], first[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            which = rank[which]
            if len(self.keys) + len(keys) > CACHED:
                self._clear()
            at = np.searchsorted(self.keys, keys)
            missing = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
            if len(missing):
                self._learn(keys[missing], slab.data, starts[first[missing]], ends[first[missing]])
                at = np.searchsorted(self.keys, keys)
            # One unit more a document: its end id, which is added to the pool for this slab.
            bound = np.searchsorted(starts, slab.offsets)
            begin = np.insert(self.at[at][which], bound[1:], len(self.pool))
            n = np.insert(self.n[at][which], bound[1:], 1)
            total = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
            ids = np.append(self.pool, np.int32(end_id))[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
            yield self._with_special(slab, ids, total[bound[1:] + np.arange(1, len(slab) + 1)], end_id)

    def _with_special(self, slab, ids: np.ndarray, stops: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Encodes documents that hold a special token's text, or all where words are not told apart so, as they are."""
        raw = slab.data.tobytes()
        if not (self.odd or any(t in raw for t in self.special)):
            return ids, stops
        out, last = [], 0
        for d, stop in enumerate(stops.tolist()):
            own = raw[slab.offsets[d] : slab.offsets[d + 1]]
            if self.odd or any(t in own for t in self.special):
                out.append(np.array([*self.full.encode(own.decode(), add_special_tokens=False).ids, end_id], np.int32))
            else:
                out.append(ids[last:stop])
            last = stop
        return np.concatenate(out), np.cumsum([len(x) for x in out])


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def chunk_marks(ids: np.ndarray) -> np.ndarray:
    """Where the last ROLL ids have a hash of a certain kind; what follows those ids is not looked at."""
    n = len(ids)
    if n < ROLL:
        return np.zeros(0, np.int64)
    power = np.full(n, _BASE, _U)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_CODES[ids] * power, out=sums[1:])
    back = np.full(n, _INVERSE, _U)
    back[0] = 1
    back = np.multiply.accumulate(back)
    rolled = (sums[ROLL:] - sums[:-ROLL]) * back[: n - ROLL + 1]
    return np.flatnonzero(mix(rolled) % _U(MEAN - LEAST) == 0) + ROLL


def chunk_ends(n: int, marks: list[int]) -> list[int]:
    """Where the chunks of n ids end: at marks, LEAST to MOST apart."""
    out, last = [], 0
    for m in [*marks, n]:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST or m == n and m > last:
            last = m
            out.append(m)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the tree that pairs neighbours; a last one without neighbour rises."""
    while len(leaves) > 1:
        leaves = [hashlib.blake2b(b"".join(leaves[i : i + 2]), digest_size=DIGEST).digest() if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else b""


class GrowingMerkle:
    """The same root over leaves that arrive one by one, in memory of the logarithm of their number."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.stack and self.stack[-1][0] == height:
            leaf = hashlib.blake2b(self.stack.pop()[1] + leaf, digest_size=DIGEST).digest()
            height += 1
        self.stack.append((height, leaf))

    def root(self) -> bytes:
        rest = [x for _, x in self.stack]
        while len(rest) > 1:
            rest[-2:] = [hashlib.blake2b(rest[-2] + rest[-1], digest_size=DIGEST).digest()]
        return rest[0] if rest else b""


def _leaf(*parts) -> bytes:
    """What stands for a document, or a range, in the tree above it."""
    return hashlib.blake2b(b"|".join(x if isinstance(x, bytes) else str(x).encode() for x in parts), digest_size=DIGEST).digest()


_encoders: dict[str, Encoder] = {}
_DATA = "kind string, row long, digest binary, n int, ids binary, doc_id long, n_tokens long, digests binary, lengths array<int>, root binary"


def _encoded(path: str, end_id: int):
    def run(batches):
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        width = np.uint16 if max(encoder.size, end_id + 1) <= 1 << 16 else np.uint32
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        seen: set[bytes] = set()

        def table(chunks, recipes):
            k, m = len(chunks), len(recipes)
            none = lambda n: [None] * n
            cols = [["chunk"] * k + ["recipe"] * m, none(k) + [r[0] for r in recipes], [c[0] for c in chunks] + none(m), [c[1] for c in chunks] + none(m), [c[2] for c in chunks] + none(m), *(none(k) + [r[j] for r in recipes] for j in (1, 2, 3, 4, 5))]
            types = [pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in _DATA.split(", ")])

        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            for ids, stops in encoder.documents(batch.column("text"), end_id):
                chunks, recipes = [], []
                marks = chunk_marks(ids)
                raw, size = ids.astype(width).tobytes(), np.dtype(width).itemsize
                starts = np.concatenate(([0], stops[:-1]))
                low, high = np.searchsorted(marks, starts + ROLL).tolist(), np.searchsorted(marks, stops).tolist()
                marks = marks.tolist()
                for start, stop, a, b in zip(starts.tolist(), stops.tolist(), low, high, strict=True):
                    digests, lengths, last = [], [], 0
                    for e in chunk_ends(stop - start, [m - start for m in marks[a:b]]):
                        own = raw[(start + last) * size : (start + e) * size]
                        digest = hashlib.blake2b(own, digest_size=DIGEST).digest()
                        digests.append(digest)
                        lengths.append(e - last)
                        if digest not in seen:
                            if len(seen) < SENT:
                                seen.add(digest)
                            chunks.append((digest, e - last, own))
                        last = e
                    recipes.append((row, next(doc_ids), stop - start, b"".join(digests), lengths, merkle(digests)))
                    row += 1
                yield table(chunks, recipes)
                del chunks, recipes, raw, ids
            give_back()

    return run


_INDEX = "part int, row long, doc_id long, local_start long, n_tokens long, digests binary, lengths array<int>, root binary, docs long"


def _indexed(batches):
    """Recipes as they come, in order; at the end the manifest row of the range."""
    part, start, docs, tree = TaskContext.get().partitionId(), 0, 0, GrowingMerkle()
    names = [f.split()[0] for f in _INDEX.split(", ")]
    for batch in batches:
        n = np.asarray(batch.column("n_tokens"))
        k = len(n)
        for leaf in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root")), strict=True):
            tree.add(_leaf(*leaf))
        local = start + np.cumsum(n) - n
        yield pa.record_batch([pa.array(np.full(k, part, np.int32)), batch.column("row"), batch.column("doc_id"), pa.array(local), batch.column("n_tokens"), batch.column("digests"), batch.column("lengths").cast(pa.list_(pa.int32())), batch.column("root"), pa.nulls(k, pa.int64())], names=names)
        start += int(n.sum())
        docs += k
    if docs:
        yield pa.record_batch([pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([start], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int32())), pa.array([tree.root()], pa.binary()), pa.array([docs], pa.int64())], names=names)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Writes the store of ``docs`` (doc_id, text) to the folder ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_encoded(tokenizer, end_id), _DATA).withColumn("key", F.coalesce("digest", F.col("row").cast("string").cast("binary")))
    first = F.row_number().over(Window.partitionBy("key").orderBy("n"))
    rows.repartition("key").withColumn("first", first).where("first = 1").drop("key", "first").write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")
    recipes = spark.read.schema(_DATA).parquet(f"{path}/data").where("kind = 'recipe'").select("row", "doc_id", "n_tokens", "digests", "lengths", "root")
    recipes.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").mapInArrow(_indexed, _INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    ranges = _manifest(spark.read.schema(_INDEX).parquet(f"{path}/index")).collect()  # a row a range
    spark.createDataFrame([_top(ranges)], _TOP).coalesce(1).write.parquet(f"{path}/manifest")


_TOP = "ranges long, docs long, tokens long, root binary"


def _manifest(index: DataFrame) -> DataFrame:
    return index.where("row IS NULL").select("part", "docs", F.col("n_tokens").alias("tokens"), "root")


def _top(ranges: list) -> tuple[int, int, int, bytes]:
    """The top manifest over (part, docs, tokens, root) of the ranges."""
    ranges = sorted((r.part, r.docs, r.tokens, bytes(r.root)) for r in ranges)
    return len(ranges), sum(r[1] for r in ranges), sum(r[2] for r in ranges), merkle([_leaf(*r) for r in ranges])


def _ranges(batches):
    """Manifest rows as the recipes have them, which come in order; a range is in one partition."""
    part, docs, tokens, tree = None, 0, 0, GrowingMerkle()
    row = lambda: pa.record_batch([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root()], pa.binary())], names=["part", "docs", "tokens", "root"])
    for batch in batches:
        for p, start, *leaf in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "doc_id", "n_tokens", "root")), strict=True):
            if p != part:
                if docs:
                    yield row()
                part, docs, tokens, tree = p, 0, 0, GrowingMerkle()
            if start != tokens:
                raise ValueError(f"a recipe of range {p} does not start where the manifest's order says")
            tree.add(_leaf(*leaf))
            docs += 1
            tokens += leaf[1]
    if docs:
        yield row()


def _check_manifests(spark: SparkSession, path: str, index: DataFrame) -> None:
    """Raises unless the recipes are those of the ranges' manifest rows, and these are those of the top one."""
    said = _manifest(index).collect()
    top = [(r.ranges, r.docs, r.tokens, bytes(r.root)) for r in spark.read.schema(_TOP).parquet(f"{path}/manifest").collect()]
    if top != [_top(said)]:
        raise ValueError("the ranges of the store do not match its top manifest")
    recipes = index.where("row IS NOT NULL").select("part", "local_start", "doc_id", "row", "n_tokens", "root")
    recipes = recipes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "doc_id", "row")
    found = recipes.mapInArrow(_ranges, "part int, docs long, tokens long, root binary").collect()  # a row a range
    wrong = set(map(tuple, found)) ^ set(map(tuple, said))
    if wrong:
        raise ValueError(f"recipes of ranges {sorted({w[0] for w in wrong})} do not match their manifest")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, documents with their start, and manifest of a store; raises where manifests and recipes differ."""
    chunks = spark.read.schema(_DATA).parquet(f"{path}/data").where("kind = 'chunk'").select("digest", "n", "ids")
    index = spark.read.schema(_INDEX).parquet(f"{path}/index")
    _check_manifests(spark, path, index)
    manifest = _manifest(index)
    manifest = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    docs = index.where("row IS NOT NULL").drop("docs").join(manifest.select("part", "base"), "part").withColumn("start", F.col("base") + F.col("local_start"))
    return chunks, docs.select("row", "doc_id", "start", "n_tokens", "digests", "lengths", "root"), manifest


def _checked(batch) -> list[tuple[bytes, int, bytes]]:
    out = list(zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "ids")), strict=True))
    for digest, _, raw in out:
        if hashlib.blake2b(raw, digest_size=DIGEST).digest() != digest:
            raise ValueError(f"chunk {digest.hex()} does not have the content that its name says")
    return out


def _checked_chunks(batches):
    for batch in batches:
        crc = [zlib.crc32(np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()) for _, n, raw in _checked(batch)]
        yield pa.record_batch([batch.column("digest"), batch.column("n"), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])


def _checked_ids(batches):
    for batch in batches:
        _checked(batch)
        yield batch


def _steps(batches):
    """A row for each chunk of each recipe, with the bytes of 32-bit ids that follow it."""
    for batch in batches:
        rows, size, digests, after, seq = [], [], [], [], []
        for row, total, own, lengths, root in zip(*(batch.column(c).to_pylist() for c in ("row", "n_tokens", "digests", "lengths", "root")), strict=True):
            parts = [own[i : i + DIGEST] for i in range(0, len(own), DIGEST)]
            if merkle(parts) != root:
                raise ValueError(f"recipe {row} does not have the root that it says")
            left = sum(lengths)
            if left != total or len(lengths) != len(parts):
                raise ValueError(f"recipe {row} does not have the lengths that it says")
            for k, (d, n) in enumerate(zip(parts, lengths, strict=True)):
                left -= n
                rows.append(row)
                seq.append(k)
                digests.append(d)
                size.append(n)
                after.append(4 * left)
        yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(seq, pa.int32()), pa.array(digests, pa.binary()), pa.array(size, pa.int32()), pa.array(after, pa.int64())], names=["row", "seq", "digest", "size", "after"])


def _with_chunks(docs: DataFrame, chunks: DataFrame, value: str) -> DataFrame:
    """The steps of all recipes with n and ``value`` of their chunks; raises where a chunk is missing or of another length."""
    steps = docs.select("row", "n_tokens", "digests", "lengths", "root").mapInArrow(tidy(_steps), "row long, seq int, digest binary, size int, after long")
    n = F.when(F.col("n") == F.col("size"), F.col("n")).otherwise(F.raise_error(F.when(F.col("n").isNull(), "a chunk is missing").otherwise("a chunk has another length than its recipe says")).cast("int"))
    return steps.join(chunks, "digest", "left").select("row", "seq", "after", n.alias("n"), value)


_POLY = 0xEDB88320


def _times(a: int, b: np.ndarray) -> np.ndarray:
    """Products modulo the polynomial of CRC-32, bits reflected."""
    out = np.zeros_like(b)
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = np.where(b & 1, (b >> 1) ^ _POLY, b >> 1)
    return out


def followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What checksums of byte strings contribute to that of a longer one in which n bytes follow."""
    crc, n = crc.copy(), n.copy()
    power = 1 << 23  # x to the 8, for one byte
    while n.any():
        odd = (n & 1).astype(bool)
        crc[odd] = _times(power, crc[odd])
        power = int(_times(power, np.array([power], np.int64))[0])
        n >>= 1
    return crc


def _contributions(batches):
    for batch in batches:
        out = followed(np.asarray(batch.column("crc")), np.asarray(batch.column("after")))
        yield pa.record_batch([batch.column("row"), pa.array(out, pa.int64())], names=["row", "part"])


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a store; raises where a check fails."""
    chunks, docs, _ = _read(spark, path)
    sums = chunks.mapInArrow(tidy(_checked_chunks), "digest binary, n int, crc long")
    parts = _with_chunks(docs, sums, "crc").select("row", "n", "crc", "after")
    crc = parts.mapInArrow(tidy(_contributions), "row long, part long").groupBy("row").agg(F.bit_xor("part").alias("ids_crc32"))
    return docs.join(crc, "row").select("doc_id", "start", "n_tokens", "ids_crc32")


def _joined(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    group = group.sort_by("seq")
    return pa.table({"row": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([np.concatenate([np.frombuffer(x, f"<u{len(x) // n}") for x, n in zip(group.column("ids").to_pylist(), group.column("n").to_pylist(), strict=True)]).astype(np.int64).tolist()], pa.list_(pa.int64()))})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<long>): documents rebuilt from their chunks; raises where a check fails."""
    chunks, docs, _ = _read(spark, path)
    ids = _with_chunks(docs, chunks.mapInArrow(_checked_ids, "digest binary, n int, ids binary"), "ids").select("row", "seq", "n", "ids").groupBy("row").applyInArrow(_joined, "row long, ids array<long>")
    return docs.join(ids, "row").select("doc_id", "start", "ids")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes a store, in the shared folder unless ``path`` is given, and reads its checksums back."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    write_store(docs, path, tokenizer, end_id)
    return read_checksums(spark, path)
