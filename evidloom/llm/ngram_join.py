"""N-gram Jaccard join by prefix tree: which documents share most of their word n-grams.

A document's set is its distinct hashed word n-grams. Sets are globally ordered by how common
their n-grams are (counts over all documents, in a fixed-size table of hashed counters), ties by
hash, so the rarest come first. Two sets of Jaccard similarity t or more must share one of their
first ``n - ceil(t n) + 1`` n-grams, and the shorter set one of its first ``n - needed + 1``.

1. Equal sets become one class, named by a 64-bit digest of the set. All later work is on
   classes, so exact copies are never compared.
2. A class that links to another shares at least ``least_shared`` of its first n-grams by hash
   (about half of them) with those of other sets. They are sent as three bytes each to slots
   of the hash, which tell of each block of sets what is shared; classes that share less go.
3. Each class left sends its prefix, one row an n-gram, to that n-gram's group. N-grams whose counter
   is far above the mean are dealt over several salted groups.
4. In each group every class is paired with a few pivots only, a number of rows that follows the
   group's size. Verified pairs are contracted to components.
5. Groups that still hold several components: where they are small, classes are paired if the
   positions of their n-gram allow the needed overlap. Classes that large groups connect form
   blocks, in which each class is sent once for each chunk that it meets, and no pairs are made.
6. Of pairs those go whose sketches (bitmaps of the parities of hashed members) differ in more
   bits than similar sets differ in members. The others' sets are compared in ``trie_matches``: candidates, most common n-gram first, form a prefix
   tree; a walk counts each shared prefix once for all probes and leaves subtrees whose remaining
   lengths cannot reach the needed overlap.

Every link between classes of different components is found, whatever a group's size; inside a
component further links cannot change the result and are not looked for. Class names are 64-bit
digests: two different sets fall together with probability 2**-64 a pair.

Null and empty texts have no set and link with nothing. Repeated rows (equal doc_id) are rows of
their own with equal results. Rows with null doc_id take part, but never name a component unless
no other member has an id. A class is sent from the row of its least doc_id, or, where no row of
it has one, from any of its rows, found by the class itself.
"""

from __future__ import annotations

import hashlib
import math
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evidloom.llm.components import connected_components
from evidloom.llm.scratch import remove, shielded, small_batches, written
from evidloom.llm.textvec import NOT_SPACE, mix, shingles, slabs, span_hashes, tidy, words

_U = np.uint64
COUNTERS = 1 << 20  # of the table of counts: 4 MB, the bound of what is broadcast
_PIECE = 1 << 12  # counters in a row
SALT_ABOVE = 2000  # rows above the mean counter that one group takes,
NOISE = 8  # and standard deviations of a counter at least, so that n-grams which only share a full counter are not salted
PIVOTS = 3
BITS = 25  # 2**25 bits, 4 MB, of the bitmap of documents to be verified
_PIECE_BITS = 1 << 15
PAIRED = 32  # classes of a group that are paired one by one; more are met in blocks
CHUNK = 150_000  # n-grams of a chunk of a block
BAND = 1.12  # ratio of set sizes within a chunk of a block of several
ANCHOR_GROUP = 256  # candidates of an anchor in one group
SLOTS = 1 << 10  # that n-grams are sent to by hash; with the three bytes sent 2**34 values are told apart
BLOCK = 1 << 19  # n-grams after which a task ends a block of sets,
BLOCK_SETS = 1 << 15  # or sets


def sets_of(column, size: int):
    """For each document of an Arrow column its sorted distinct n-gram hashes."""
    for slab in slabs(column):
        w, data = words(slab, NOT_SPACE)
        grams, at = shingles(span_hashes(data, w.starts, w.ends), w.offsets, size)
        for d in range(len(slab)):
            own = np.sort(grams[at[d] : at[d + 1]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own


def class_of(own: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if len(own) else None


def sketch_of(own: np.ndarray) -> np.ndarray:
    """A bitmap of the parities of hashed members, of about two bits a member (64 to 65,536)."""
    size = min(1 << 16, max(64, 1 << (2 * len(own) - 1).bit_length()))
    return np.packbits(np.bincount((own >> _U(48)).astype(np.int64) % size, minlength=size) & 1 == 1)


def could_link(n: int, x: np.ndarray, m: int, y: np.ndarray, percent: int) -> bool:
    """Whether sets of n and m members with sketches x and y may have that similarity.

    No sketches differ in more bits than their sets in members, so this rejects no link.
    """
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)))
    most = n + m - 2 * (-(-percent * (n + m) // (100 + percent)))
    return int(np.bitwise_count(x ^ y).sum()) <= most


def _could_link(percent: int):
    def test(n: pd.Series, x: pd.Series, m: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([could_link(i, np.frombuffer(a, np.uint8), k, np.frombuffer(b, np.uint8), percent) for i, a, k, b in zip(n.tolist(), x, m.tolist(), y, strict=True)], dtype=bool)

    return F.pandas_udf(test, "boolean")


def _counter(own: np.ndarray) -> np.ndarray:
    return (own >> _U(44)).astype(np.int64)  # COUNTERS is 2**20


def in_order(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set, rarest first; the same order in every set."""
    rare = counts[_counter(own)].astype(_U)
    return own[np.argsort((rare << _U(32)) | (own >> _U(32)), kind="stable")]


def _more(n):
    """How many n-grams beyond the prefix are sent of a set of n members."""
    return -(-n // 4)


def sent(n, percent: int):
    """How many of n members are sent to slots, the least hashes first."""
    return np.minimum(n, n - -(-percent * n // 100) + _more(n))


def least_shared(n, percent: int):
    """How many of those a set of n members shares at least with any set similar to it.

    The i-th of the common members is in the first ``n - overlap + i`` of either set, so the first ``_more``
    of the smaller set are sent of both; and the smaller one has percent of n members or more.
    """
    return _more(-(-percent * n // 100))


def _to_slots(firsts: list[np.ndarray]):
    """(slot, which sets, three bytes a member) of each slot that members of these sets belong to.

    ``which``: bits, for each set in turn a 1 for each member and a 0.
    """
    flat = np.concatenate(firsts)
    slot = (flat & _U(SLOTS - 1)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    at = np.searchsorted(slot[order], np.arange(SLOTS + 1))
    row = np.repeat(np.arange(len(firsts)), [len(x) for x in firsts])[order]
    value = ((flat[order] >> _U(10)) & _U(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    for k in np.flatnonzero(at[1:] > at[:-1]).tolist():
        own = row[at[k] : at[k + 1]]
        bits = np.zeros(len(own) + len(firsts), bool)
        bits[own + np.arange(len(own))] = True
        yield k, np.packbits(bits).tobytes(), value[at[k] : at[k + 1]].tobytes()


def _shared_in_slot(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Of each block the sets whose members another set has too, one number a member."""
    blocks = group.column("block").to_pylist()
    ones = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for x in group.column("which").to_pylist()]
    row = np.concatenate([x - np.arange(len(x)) for x in ones]).astype(np.uint16)
    value = np.zeros((len(row), 4), np.uint8)
    value[:, :3] = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("members").to_pylist()]).reshape(-1, 3)
    value = value.view("<u4").ravel()
    order = np.argsort(value, kind="stable")
    same = np.diff(value[order]) == 0
    shared = np.zeros(len(value), bool)
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    at = np.cumsum([0, *map(len, ones)])
    parts = [row[i:j][shared[i:j]] for i, j in zip(at, at[1:])]
    some = [i for i, x in enumerate(parts) if len(x)]
    return pa.table({"block": pa.array([blocks[i] for i in some], pa.int64()), "which": pa.array([parts[i].tobytes() for i in some], pa.binary()), "members": pa.nulls(len(some), pa.binary())})


def _left_of_block(percent: int):
    """The classes of a block that share enough; the row with members has all of them and their sizes."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        which, members = group.column("which").to_pylist(), group.column("members").to_pylist()
        n, cls = next((np.frombuffer(x, np.int64), np.frombuffer(m, np.int64)) for x, m in zip(which, members, strict=True) if m is not None)
        shared = np.bincount(np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x, np.uint16) for x, m in zip(which, members, strict=True) if m is None)]), minlength=len(n))
        return pa.table({"cls": pa.array(cls[shared >= least_shared(n, percent)], pa.int64())})

    return run


def _scan(size: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("sketch", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary()), ("block", pa.int64()), ("slot", pa.int32()), ("which", pa.binary()), ("members", pa.binary())])
    rows = lambda k, **cols: pa.record_batch([cols[f.name] if f.name in cols else pa.nulls(k, f.type) for f in schema], schema=schema)

    def ended(block):
        """Rows of a block: what goes to slots, and its classes with their sizes (slot -1)."""
        name = int.from_bytes(os.urandom(8), "little", signed=True)
        slots, which, members = zip(*_to_slots([x for *_, x in block]), strict=True)
        slots, which, members = [-1, *slots], [np.array([n for _, n, _ in block], np.int64).tobytes(), *which], [np.array([c for c, *_ in block], np.int64).tobytes(), *members]
        return rows(len(slots), block=pa.array([name] * len(slots), pa.int64()), slot=pa.array(slots, pa.int32()), which=pa.array(which, pa.binary()), members=pa.array(members, pa.binary()))

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        seen: set[int] = set()
        block: list[tuple[int, int, np.ndarray]] = []
        in_block = 0
        for batch in batches:
            n, cls, sketch = [], [], []
            pending: list[np.ndarray] = []
            held = 0
            for own in sets_of(batch.column("text"), size):
                pending.append(_counter(own))
                held += len(own)
                if held > COUNTERS:
                    counts += np.bincount(np.concatenate(pending), minlength=COUNTERS).astype(np.uint32)
                    pending, held = [], 0
                n.append(len(own))
                cls.append(class_of(own))
                sketch.append(sketch_of(own).tobytes() if len(own) else None)
                if len(own) and cls[-1] not in seen:
                    if len(seen) < 200_000:  # copies in one task
                        seen.add(cls[-1])
                    block.append((cls[-1], n[-1], own[: sent(n[-1], percent)].copy()))
                    in_block += len(block[-1][2])
                if in_block >= BLOCK or len(block) >= BLOCK_SETS:
                    yield ended(block)
                    block, in_block = [], 0
            if pending:
                counts += np.bincount(np.concatenate(pending), minlength=COUNTERS).astype(np.uint32)
            k = len(n)
            yield rows(k, doc_id=batch.column("doc_id").cast(pa.int64()), n=pa.array(n, pa.int64()), cls=pa.array(cls, pa.int64()), sketch=pa.array(sketch, pa.binary()))
        if block:
            yield ended(block)
        pieces = counts.reshape(-1, _PIECE)
        some = np.flatnonzero(pieces.any(axis=1))
        yield rows(len(some), piece=pa.array(some, pa.int32()), counts=pa.array([pieces[i].tobytes() for i in some], pa.binary()))

    return run


def _add_pieces(batches):
    """Adds tables of counts as they stream by; holds one piece of each kind."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, blob in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(blob, np.uint32)
            total[piece] = np.minimum(total.get(piece, 0) + x.astype(np.uint64), 2**32 - 1)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["piece", "counts"])


def _prefixes(size: int, percent: int, counts, named, left):
    """Prefixes of the classes in the bitmap ``left``, from the rows without doc_id and those in ``named``."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("cls", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        table, ids, classes = np.frombuffer(counts.value, np.uint32), np.frombuffer(named.value, np.uint8), np.frombuffer(left.value, np.uint8)
        salted = 1 + (np.maximum(table - table.mean(), 0) // max(SALT_ABOVE, NOISE * float(table.mean()) ** 0.5)).astype(np.int32)
        seen: set[int] = set()
        for batch in batches:
            parts: list[tuple[np.ndarray, int, int]] = []
            held = 0
            id = batch.column("doc_id")
            batch = batch.filter(pa.array(_in(ids, id.fill_null(0).to_numpy()) | id.is_null().to_numpy(zero_copy_only=False)))
            for own in sets_of(batch.column("text"), size):
                cls = class_of(own)
                if cls is None or cls in seen or not _in(classes, np.array([cls], np.int64))[0]:
                    continue
                if len(seen) < 200_000:  # copies in one task; any others fall together later
                    seen.add(cls)
                n = len(own)
                parts.append((in_order(own, table)[: n - -(-percent * n // 100) + 1], cls, n))
                held += len(parts[-1][0])
                if held > 200_000:
                    yield from _flat(parts, salted, schema)
                    parts, held = [], 0
            yield from _flat(parts, salted, schema)

    return run


def _flat(parts, salted, schema):
    if not parts:
        return
    length = np.array([len(p[0]) for p in parts])
    token = np.concatenate([p[0] for p in parts])
    cls = np.repeat(np.array([p[1] for p in parts], np.int64), length)
    n = np.repeat(np.array([p[2] for p in parts], np.int32), length)
    pos = (np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
    salts = salted[_counter(token)]
    salt = ((cls.view(_U) >> _U(7)) % salts.astype(_U)).astype(np.int32)
    yield pa.record_batch([pa.array(x) for x in (token.view(np.int64), salt, salts, cls, n, pos)], schema=schema)


def trie_matches(probes: list[np.ndarray], sets: list[np.ndarray], percent: int):
    """Yields (set, probes that have that similarity with it), by number; all sets are in one global order.

    ``sets``, sorted as sequences, are walked as a path-compressed prefix tree. The members on an
    edge are looked up in all probes once for all sets below it. Probes that could not reach the
    needed overlap with the remaining lengths leave the walk, and a subtree without probes is cut.
    """
    if not probes or not sets:
        return
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    seqs = [sets[i] for i in order]
    size = np.array([len(s) for s in seqs])
    lcp = [0] * (len(seqs) + 1)
    for k in range(1, len(seqs)):
        m = min(size[k - 1], size[k])
        differ = np.flatnonzero(seqs[k - 1][:m] != seqs[k][:m])
        lcp[k] = int(differ[0]) if len(differ) else int(m)
    known = np.intersect1d(np.concatenate(probes), np.concatenate(seqs))
    has = np.zeros((len(known) + 1, len(probes)), np.uint8)  # the last row is of members that no probe has
    for k, p in enumerate(probes):
        at = np.searchsorted(known, p)
        at = at[known[np.minimum(at, len(known) - 1)] == p] if len(known) else at[:0]
        has[at, k] = 1
    length = np.array([len(p) for p in probes])
    least = lambda n, m: -(-percent * (n + m) // (100 + percent))
    todo = [(0, len(seqs), 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
    while todo:
        lo, hi, depth, alive, overlap = todo.pop()
        own = length[alive]
        best = overlap + np.minimum(size[lo:hi].max() - depth, own - overlap)
        stay = best >= least(size[lo:hi].min(), own)
        if not stay.any():
            continue
        alive, overlap, own = alive[stay], overlap[stay], own[stay]
        end = min(lcp[lo + 1 : hi]) if hi - lo > 1 else int(size[lo])
        edge = seqs[lo][depth:end]
        if len(edge) and len(known):
            at = np.searchsorted(known, edge)
            at = np.where(known[np.minimum(at, len(known) - 1)] == edge, at, len(known))
            rows = has[at]
            overlap = overlap + (rows if len(alive) == len(probes) else rows[:, alive]).sum(axis=0, dtype=np.int64)
        if hi - lo == 1:
            hit = alive[overlap >= least(size[lo], own)]
            if len(hit):
                yield order[lo], hit
            continue
        cut = lo
        for k in range(lo + 1, hi + 1):
            if k == hi or lcp[k] == end:
                todo.append((cut, k, end, alive, overlap))
                cut = k


def _arrays(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, _U) for x in group.column("grams").to_pylist()]


def _verify(percent: int):
    """The candidates of one anchor that are similar to it."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        anchor = key[0].as_py()
        ids, grams = group.column("cls").to_pylist(), _arrays(group)
        at = ids.index(anchor)
        others = [i for i in range(len(ids)) if i != at]
        hit = [ids[others[i]] for i, _ in trie_matches([grams[at]], [grams[i] for i in others], percent)]
        return pa.table({"a": pa.array([anchor] * len(hit), pa.int64()), "b": pa.array(hit, pa.int64())})

    return run


def _verify_block(percent: int):
    """Links between two chunks of a block, as many as join components."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        ids, comp, grams = group.column("cls").to_pylist(), group.column("comp").to_pylist(), _arrays(group)
        side = group.column("side").to_pylist()
        left = [i for i, s in enumerate(side) if s != 1]  # 0 and 1 are the two chunks, 2 is a chunk beside itself
        right = [i for i, s in enumerate(side) if s != 0]
        root = {c: c for c in comp}

        def of(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        for i, hits in trie_matches([grams[k] for k in left], [grams[k] for k in right], percent):
            i = right[i]
            for j in hits:
                x, y = of(comp[i]), of(comp[left[j]])
                if x != y:
                    root[x] = y
                    a.append(min(ids[i], ids[left[j]]))
                    b.append(max(ids[i], ids[left[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(_U)) >> _U(64 - BITS)).astype(np.int64)


def _in(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _bit(ids)
    return (bits[at >> 3] >> (7 - (at & 7))) & 1 == 1


def _bitmap(batches):
    """Pieces of the bitmap of the ids that stream by; each piece is in one partition."""
    pieces: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, bit in zip(batch.column("piece").to_pylist(), batch.column("bit").to_pylist(), strict=True):
            pieces.setdefault(piece, np.zeros(_PIECE_BITS, bool))[bit] = True
    yield pa.record_batch([pa.array(list(pieces), pa.int64()), pa.array([np.packbits(x).tobytes() for x in pieces.values()], pa.binary())], names=["piece", "bits"])


def bitmap(ids: DataFrame):
    """A broadcast bitmap of hashed doc_ids: fixed in size, so what it lets through is to be looked up exactly."""
    udf = F.pandas_udf(lambda x: pd.Series(_bit(x.to_numpy(np.int64))), "long")
    bits = ids.select(udf("doc_id").alias("at")).select(F.floor(F.col("at") / _PIECE_BITS).alias("piece"), (F.col("at") % _PIECE_BITS).alias("bit"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for piece, blob in bits.repartition(16, "piece").mapInArrow(_bitmap, "piece long, bits binary").collect():  # 4 MB at most, in one job
        out[piece * _PIECE_BITS // 8 : (piece + 1) * _PIECE_BITS // 8] = np.frombuffer(blob, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out.tobytes())


def _marked(bits):
    """Whether an id (null: 0) is in that bitmap."""
    return F.pandas_udf(lambda ids: pd.Series(_in(np.frombuffer(bits.value, np.uint8), ids.fillna(0).to_numpy(np.int64))), "boolean")


def _ordered_sets(size: int, counts, marks):
    def run(batches):
        table, bits = np.frombuffer(counts.value, np.uint32), np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(_in(bits, np.asarray(batch.column("doc_id")))))  # of documents that have one
            cls, out = [], []
            for own in sets_of(batch.column("text"), size):
                cls.append(class_of(own))
                out.append(in_order(own, table)[::-1].tobytes())
            yield pa.record_batch([pa.array(cls, pa.int64()), batch.column("doc_id"), pa.array(out, pa.binary())], names=["cls", "doc_id", "grams"])

    return run


def _ordered_sets_of_nameless(size: int, counts, marks):
    """The same of rows without doc_id, marked by class; of each class one row a task, as far as 200,000 are remembered."""

    def run(batches):
        table, bits = np.frombuffer(counts.value, np.uint32), np.frombuffer(marks.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            cls, out = [], []
            for own in sets_of(batch.column("text"), size):
                c = class_of(own)
                if c is None or c in seen:
                    continue
                if not _in(bits, np.array([c], np.int64))[0]:
                    continue
                if len(seen) < 200_000:
                    seen.add(c)
                cls.append(c)
                out.append(in_order(own, table)[::-1].tobytes())
            yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(out, pa.binary())], names=["cls", "grams"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.spark, self.size, self.percent = docs.sparkSession, size, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.paths: list[str] = []
        small_batches(self.spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        self.paths.append(path)
        return df

    def need(self, n: str, m: str) -> str:
        """SQL of the least overlap of sets of n and m members."""
        return f"(({self.percent} * ({n} + {m}) + {99 + self.percent}) div {100 + self.percent})"

    def with_sets(self, members: DataFrame) -> DataFrame:
        """``members``, which have cls, with grams: the class's n-grams, most common first."""
        one = self.keep(self.classes.join(members.select("cls").distinct(), "cls").select("cls", "doc_id"), "one")
        sets = self.docs.where("doc_id IS NOT NULL").mapInArrow(tidy(_ordered_sets(self.size, self.counts, bitmap(one.where("doc_id IS NOT NULL")))), "cls long, doc_id long, grams binary")
        if self.nameless:
            bare = one.where("doc_id IS NULL").select("cls")
            bits = bitmap(bare.select(F.col("cls").alias("doc_id")))
            own = self.docs.where("doc_id IS NULL").mapInArrow(tidy(_ordered_sets_of_nameless(self.size, self.counts, bits)), "cls long, grams binary")
            own = own.join(bare, "cls", "left_semi").groupBy("cls").agg(F.first("grams").alias("grams"))
            sets = sets.union(own.select("cls", F.lit(0).cast("long").alias("doc_id"), "grams"))
            one = one.fillna(0, ["doc_id"])  # the class is in the key too, so an id of 0 is not mistaken
        return members.join(one, "cls").join(sets.hint("merge"), ["cls", "doc_id"]).drop("doc_id")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the (a, b) that are similar; b's of an anchor are dealt over groups."""
        a, b = (self.classes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        pairs = pairs.join(a, "a").join(b, "b").where(_could_link(self.percent)("n_a", "sketch_a", "n_b", "sketch_b")).select("a", "b")
        pairs = self.keep(pairs, "pairs")
        groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / ANCHOR_GROUP).cast("int").alias("groups"))
        pairs = pairs.join(groups, "a").withColumn("part", F.pmod(F.xxhash64("b"), "groups").cast("int"))
        anchors = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("a").alias("cls"))
        members = pairs.select("a", "part", F.col("b").alias("cls")).union(anchors)
        return self.with_sets(members).groupBy("a", "part").applyInArrow(_verify(self.percent), "a long, b long")

    def block_links(self, rows: DataFrame) -> DataFrame:
        """Links between components among the classes that n-grams of large groups connect.

        ``rows`` has token, cls, n and comp. Connected classes form a block. One of more than CHUNK
        n-grams is dealt over chunks of about as many, of sets of like size; a component beyond
        that has chunks of its own. Two chunks of a block meet in one task unless they are of one
        component or no two of their sets are near enough in size.
        """
        percent = self.percent
        rows = self.keep(rows, "rows")
        least = rows.groupBy("token").agg(F.min("cls").alias("least"))
        blocks = connected_components(rows.join(least, "token").select(F.col("cls").alias("a"), F.col("least").alias("b")))
        members = rows.select("cls", "n", "comp").distinct().join(blocks.select(F.col("node").alias("cls"), F.col("component").alias("block")), "cls")
        members = self.keep(members, "members")
        total = members.groupBy("block", "comp").agg(F.sum("n").alias("total"))
        whole = total.groupBy("block").agg(F.sum("total").alias("whole"))
        band = F.when(F.col("whole") > CHUNK, F.floor(F.log("n") / math.log(BAND)).cast("int")).otherwise(0)
        members = members.join(total, ["block", "comp"]).join(whole, "block").select("cls", "n", "comp", "block", F.when(F.col("total") > CHUNK, F.col("comp")).alias("owner"), band.alias("band"))
        members = self.keep(members, "members")
        chunks = members.groupBy("block", "owner", "band").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
        placed = members.join(chunks.select(F.col("block").alias("_b"), F.col("owner").alias("_o"), F.col("band").alias("_d"), "chunks"), F.expr("block = _b AND owner <=> _o AND band = _d"))
        placed = placed.select("cls", "n", "comp", "block", F.struct("owner", "band", F.pmod(F.xxhash64("cls"), "chunks").cast("int").alias("k")).alias("chunk"))
        placed = self.keep(placed, "placed")
        all_chunks = placed.groupBy("block", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        i, j = (all_chunks.select("block", *[F.col(c).alias(f"{c}_{side}") for c in ("chunk", "lo", "hi")]) for side in "ij")
        meet = i.join(j, "block").where(f"chunk_i <= chunk_j AND NOT coalesce(chunk_i.owner = chunk_j.owner, false) AND lo_i * {percent} <= hi_j * 100 AND lo_j * {percent} <= hi_i * 100")
        meet = meet.select("block", F.col("chunk_i").alias("i"), F.col("chunk_j").alias("j"))
        meet = meet.select("block", "i", "j", F.explode(F.expr("CASE WHEN i = j THEN array(struct(i AS chunk, 2 AS side)) ELSE array(struct(i AS chunk, 0 AS side), struct(j AS chunk, 1 AS side)) END")).alias("x"))
        seats = meet.select("block", "i", "j", "x.chunk", "x.side").join(placed, ["block", "chunk"]).select("block", "i", "j", "side", "cls", "comp")
        return self.with_sets(seats).groupBy("block", "i", "j").applyInArrow(_verify_block(self.percent), "a long, b long")

    def components(self) -> DataFrame:
        size, percent = self.size, self.percent
        scan, path = written(self.docs.mapInArrow(tidy(_scan(size, percent)), "doc_id long, n long, cls long, sketch binary, piece int, counts binary, block long, slot int, which binary, members binary"), "sets")
        self.per_doc = self.keep(scan.where("piece IS NULL AND slot IS NULL").select("doc_id", "n", "cls"), "docs")
        pieces = scan.where("piece IS NOT NULL").select("piece", "counts").repartition(16, "piece").mapInArrow(_add_pieces, "piece int, counts binary")
        counts = np.zeros(COUNTERS, np.uint32)
        for piece, blob in pieces.collect():  # at most COUNTERS counters, whatever the input
            counts[piece * _PIECE : (piece + 1) * _PIECE] = np.frombuffer(blob, np.uint32)
        self.counts = self.spark.sparkContext.broadcast(counts.tobytes())
        shared = scan.where("slot >= 0").select("slot", "block", "which", "members").groupBy("slot").applyInArrow(_shared_in_slot, "block long, which binary, members binary")
        left = scan.where("slot = -1").select("block", "which", "members").union(shared).groupBy("block").applyInArrow(_left_of_block(percent), "cls long")
        left = bitmap(self.keep(left, "left").select(F.col("cls").alias("doc_id")))
        # A bitmap also lets some others through, which do no harm.
        named = scan.where("cls IS NOT NULL").select("cls", "doc_id", "n", "sketch").where(_marked(left)("cls"))
        named = named.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.classes = self.keep(named, "classes")
        self.nameless = self.classes.where("doc_id IS NULL").count() > 0
        remove(self.spark, path)

        senders = bitmap(self.classes.where("doc_id IS NOT NULL"))
        rows = self.docs.mapInArrow(tidy(_prefixes(size, percent, self.counts, senders, left)), "token long, salt int, salts int, cls long, n int, pos int")
        group = Window.partitionBy("token", "salt")
        pivots = [F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "n", "pos")).over(group).alias(f"p{k}") for k in range(PIVOTS)]
        shared = (
            rows.repartition(F.col("token"), F.col("salt"))
            .select("*", F.lag("cls").over(group.orderBy("cls")).alias("last"), F.lead("cls").over(group.orderBy("cls")).alias("next"))
            .where("(last IS NULL OR last <> cls) AND (last IS NOT NULL OR next IS NOT NULL OR salts > 1)")
            .select("*", F.min("cls").over(group).alias("lo"), F.max("cls").over(group).alias("hi"), *pivots)
            .where("lo <> hi OR salts > 1")
            .select("token", "salts", "cls", "n", "pos", *[f"p{k}" for k in range(PIVOTS)])
        )
        shared = self.keep(shared, "shared")

        pivot = F.array_distinct(F.array(*[F.struct(f"p{k}.cls", f"p{k}.n", f"p{k}.pos") for k in range(PIVOTS)]))
        star = shared.select("cls", "n", "pos", F.array_contains(F.transform(pivot, lambda p: p["cls"]), F.col("cls")).alias("own"), F.explode(pivot).alias("p"))
        star = star.where("cls <> p.cls AND (NOT own OR cls > p.cls)").drop("own")  # a pair of pivots counts once a token
        far = Window.partitionBy("token").orderBy("cls")
        tops = shared.where("salts > 1 AND cls = p0.cls").select("cls", "n", "pos", F.first(F.struct("cls", "n", "pos")).over(far).alias("p")).where("cls <> p.cls")
        near = star.union(tops).where(f"least(n, p.n) * 100 >= greatest(n, p.n) * {percent}")
        near = near.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b"), (F.col("n") + F.col("p.n")).alias("both"), (F.least(F.col("n") - F.col("pos"), F.col("p.n") - F.col("p.pos")) - 1).alias("left"))
        near = near.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("left").alias("left"), F.max("left").alias("most"), F.first("both").alias("both"))
        first = self.keep(self.links(near.where(f"c + left >= {self.need('both', '0')} AND most + 1 >= {self.need('both', '0')}").select("a", "b")), "links")
        comp = self.keep(connected_components(first), "comp")

        placed = shared.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("token", "cls", "n", "pos", F.coalesce("component", "cls").alias("comp"))
        index = f"n - pos >= {self.need('n', 'n')}"  # the shorter set of a pair has the n-gram so early
        mixed = placed.groupBy("token").agg(F.count("*").alias("rows"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.expr(f"min(CASE WHEN {index} THEN n END)").alias("n0"), F.expr(f"max(CASE WHEN {index} THEN n END)").alias("n1"))
        placed = self.keep(placed.join(mixed.where("c0 <> c1").drop("c0", "c1"), "token"), "mixed")
        many, few = placed.where(F.col("rows") > PAIRED), placed.where(F.col("rows") <= PAIRED)

        # Of a pair the n-grams are counted that both have in small groups, and the least that can
        # follow the last of them; of those in large groups all of one set could be in the other.
        uncounted = many.groupBy("cls").agg(F.count("*").cast("int").alias("uncounted"))
        few = few.select("token", "cls", "n", "pos", "comp").join(uncounted, "cls", "left").fillna(0, ["uncounted"])
        other = few.select("token", *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "pos", "comp", "uncounted")])
        cross = few.join(other, "token").where(f"cls < cls_b AND comp <> comp_b AND least(n, n_b) * 100 >= greatest(n, n_b) * {percent}")
        cross = cross.select(F.col("cls").alias("a"), F.col("cls_b").alias("b"), (F.col("n") + F.col("n_b")).alias("both"), F.least("uncounted", "uncounted_b").alias("more"), (F.least(F.col("n") - F.col("pos"), F.col("n_b") - F.col("pos_b")) - 1).alias("left"))
        cross = cross.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("left").alias("left"), F.max("left").alias("most"), F.first("both").alias("both"), F.first("more").alias("more"))
        cross = cross.where(f"c + more + left >= {self.need('both', '0')} AND most + more + 1 >= {self.need('both', '0')}").select("a", "b")

        shorter = f"greatest(n0, ({percent} * n + 99) div 100)"
        many = many.where("n0 IS NOT NULL").where(f"({index}) OR (n0 <= n AND n1 * 100 >= n * {percent} AND n - pos >= {self.need('n', shorter)})").select("token", "cls", "n", "comp")
        second = self.keep(self.links(cross), "links").union(self.keep(self.block_links(many), "links"))
        return self.keep(connected_components(first.union(second)), "comp")


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Documents link when 100 * |A and B| >= percent * |A or B| over their distinct word n-grams;
    component_id is the least doc_id that links reach. ``percent`` is over 50.
    """
    join = _Join(docs, size, percent)
    comp = join.components()
    named = join.per_doc.join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.select("doc_id", "n", F.coalesce("component", "cls").alias("comp"))
    least = named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out, path = written(out, "ngram-join")
    remove(join.spark, *join.paths)
    return out


def one_of_each_group(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their group, once each; rows without doc_id stay.

    Ids that may have to go are marked in a bitmap of fixed size. Other rows stay as they are
    read; only marked ones are shuffled, to be looked up exactly.
    """
    found = ngram_join(docs, size, percent).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("rows"), F.min("component_id").alias("first"))
    suspect, _ = written(found.where("rows > 1 OR first <> _id").select(F.col("_id").alias("doc_id"), (F.col("first") != F.col("_id")).alias("_gone")), "suspects")
    rows, back = shielded(docs, "doc_id", "text")
    marked = rows.withColumn("_marked", _marked(bitmap(suspect))(F.col("doc_id").cast("long")))
    sure = marked.where("doc_id IS NULL OR NOT _marked").drop("_marked")
    looked_up = marked.where("doc_id IS NOT NULL AND _marked").drop("_marked").join(suspect, "doc_id", "left").where("_gone IS NULL OR NOT _gone").drop("_gone")
    return back(sure.unionByName(looked_up.dropDuplicates(["doc_id"])))
