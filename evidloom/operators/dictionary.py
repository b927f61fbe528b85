"""Whole-word matches of a dictionary of any size in texts, by Aho-Corasick automata over words.

Patterns are dealt by hash into blocks of about ``BLOCK`` words; a task builds the automaton of a block
as sorted arrays: edges (state and word), the state to fall back to, the pattern that ends in a state,
and the next shorter state in which one ends. An automaton takes about 60 bytes a word of its block, so
some 12 MB; they come to the driver and go to the executors one by one, and a worker loads one at a time.
Texts are read once: each batch runs through all automata, in stretches of ``STEP`` words abreast, each
of which starts as many words early as the longest pattern needs. No text is shuffled, and no text is
held against single patterns. Rows of one key meet once, in the sums of their hits.

Words are compared by their 64-bit hashes. Null texts and texts without words match nothing, and so
do patterns without words; equal patterns are one.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evidloom.functions.text import tokens
from evidloom.tables import stored

BLOCK = 200_000
STEP = 256
PIECE = 250_000  # words of texts that run through an automaton at a time: each may end as many patterns as the longest has words


class Automaton:
    """States are numbered by depth; 0 is the start."""

    def __init__(self, patterns: list[np.ndarray]):
        """``patterns`` are different sequences of word hashes, none empty."""
        length = np.array([len(p) for p in patterns])
        flat = np.concatenate([*patterns, np.zeros(0, np.int64)])
        self.words, word = np.unique(flat, return_inverse=True)
        self.longest = int(length.max(initial=0))
        start, size = np.cumsum(length) - length, len(self.words)
        state = np.zeros(len(patterns), np.int64)
        keys, fall, ends, shorter = [], [np.zeros(1, np.int64)], [np.full(1, -1)], [np.zeros(1, np.int64)]
        self.keys, self.to, n = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        for depth in range(self.longest):
            own = np.flatnonzero(length > depth)
            step = state[own] * size + word[start[own] + depth]
            new, to = np.unique(step, return_inverse=True)
            state[own] = n + to
            # Where the states of this depth fall back to: on from where their parents do.
            parent, by = new // size, new % size
            back = self._on(np.concatenate(fall)[parent], by, np.concatenate(fall)) if depth else np.zeros(len(new), np.int64)
            end = np.full(len(new), -1)
            last = own[length[own] == depth + 1]
            end[state[last] - n] = last
            fall.append(back)
            all_ends, all_shorter = np.concatenate(ends), np.concatenate(shorter)
            shorter.append(np.where(all_ends[back] >= 0, back, all_shorter[back]))
            ends.append(end)
            keys.append(new)
            self.keys, self.to = np.concatenate(keys), np.arange(1, n + len(new))
            order = np.argsort(self.keys)
            self.keys, self.to = self.keys[order], self.to[order]
            n += len(new)
        self.fall, self.ends, self.shorter = np.concatenate(fall), np.concatenate(ends), np.concatenate(shorter)

    def _on(self, state: np.ndarray, word: np.ndarray, fall: np.ndarray) -> np.ndarray:
        """The states that follow on a word (less than 0: one that no pattern has)."""
        state = np.where(word < 0, 0, state)
        out, open_ = np.zeros(len(state), np.int64), np.flatnonzero(word >= 0)
        while len(open_):
            key = state[open_] * len(self.words) + word[open_]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            out[open_[found]] = self.to[at[found]]
            open_ = open_[~found & (state[open_] > 0)]
            state[open_] = fall[state[open_]]
        return out

    def matches(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, word at which it starts) of every match in texts of word hashes."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(hashes):
            return none, none, none
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        word = np.where(self.words[at] == hashes, at, -1)
        # Stretches of STEP words, none over a text's end.
        count = np.diff(offsets)
        pieces = -(-count // STEP)
        text = np.repeat(np.arange(len(count)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = offsets[:-1][text] + number * STEP
        last = np.minimum(first + STEP, offsets[1:][text])
        place = np.maximum(first - self.longest + 1, offsets[:-1][text])
        state, out = np.zeros(len(text), np.int64), []
        live = np.arange(len(text))
        while len(live):
            here = place[live]
            state[live] = now = self._on(state[live], word[here], self.fall)
            counts = here >= first[live]  # before, a stretch only warms up
            who, now, here = live[counts], now[counts], here[counts]
            now = np.where(self.ends[now] >= 0, now, self.shorter[now])
            while True:
                some = now > 0
                if not some.any():
                    break
                who, now, here = who[some], now[some], here[some]
                out.append(np.stack((text[who], self.ends[now], here)))
                now = self.shorter[now]
            place[live] += 1
            live = live[place[live] < last[live]]
        if not out:
            return none, none, none
        text, pattern, end = np.concatenate(out, 1)
        return text, pattern, end - offsets[text] - self.lengths[pattern] + 1

    @property
    def lengths(self) -> np.ndarray:
        """Words of each pattern."""
        if not hasattr(self, "_lengths"):
            depth = np.zeros(len(self.fall), np.int64)
            for key, to in sorted(zip(self.keys.tolist(), self.to.tolist(), strict=True), key=lambda x: x[1]):
                depth[to] = depth[key // len(self.words)] + 1
            self._lengths = np.zeros(int(self.ends.max()) + 1, np.int64)
            self._lengths[self.ends[self.ends >= 0]] = depth[self.ends >= 0]
        return self._lengths


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _built(table: pa.Table) -> pa.Table:
    words = table["words"].combine_chunks()
    offsets, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False)
    automaton = Automaton([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    automaton.lengths  # noqa: B018  kept with it
    return pa.table({"block": table["block"].slice(0, 1), "names": pa.array([table["name"].to_pylist()], pa.list_(pa.string())), "automaton": pa.array([pickle.dumps(automaton)], pa.binary())})


def automata(dictionary: DataFrame, pattern: str, pattern_tokens=tokens) -> DataFrame:
    """(block, names, automaton) of the distinct patterns of a table, written."""
    p = dictionary.select(F.col(pattern).cast("string").alias("name")).distinct().withColumn("words", pattern_tokens(F.col("name"))).where("size(words) > 0")
    p, _ = stored(p.select("name", hashed(F.col("words")).alias("words"), F.array_join("words", " ").alias("as")), "patterns")
    # Names that are the same words are one pattern, of the least name.
    p = p.groupBy("words").agg(F.min("name").alias("name"))
    total = p.agg(F.sum(F.size("words"))).first()[0] or 0
    dealt = p.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(max(1, -(-total // BLOCK)))).cast("int"))
    return stored(dealt.groupBy("block").applyInArrow(_built, "block int, names array<string>, automaton binary"), "automata")[0]


def dictionary_matches(texts: DataFrame, blocks: DataFrame, text: str, key: list[str], text_tokens=tokens) -> DataFrame:
    """(key, name, hits, first_at): how often each pattern stands in the texts of a key, and the first word where it does."""
    spark = texts.sparkSession
    sent = [spark.sparkContext.broadcast((r.names, r.automaton)) for r in blocks.toLocalIterator()]
    rows = texts.select(*key, hashed(text_tokens(F.col(text))).alias("_words"))

    def pieces(batch):
        """A batch in stretches of rows of ``PIECE`` words or fewer, or of one row."""
        ends = np.cumsum(batch.column("_words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
            yield batch.slice(at, to - at)
            at = to

    def run(batches):
        for batch in (piece for whole in batches for piece in pieces(whole)):
            words = batch.column("_words")
            count = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, offsets = words.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(count))
            for block in sent:
                names, automaton = block.value
                who, pattern, start = pickle.loads(automaton).matches(flat, offsets)
                if len(who):
                    both, at, hits = np.unique(who * len(names) + pattern, return_inverse=True, return_counts=True)
                    first = np.full(len(both), np.iinfo(np.int64).max)
                    np.minimum.at(first, at, start)
                    of = pa.array(both // len(names))
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(of) for k in key], pa.array(names, pa.string()).take(pa.array(both % len(names))), pa.array(hits.astype(np.int64)), pa.array(first)], [*key, "name", "hits", "first_at"])
                if len(sent) > 1:
                    vars(block).pop("_value", None)  # read again from the executor's disk when its turn comes

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    found = rows.mapInArrow(run, f"{kinds}, name string, hits long, first_at long")
    return found.groupBy(*key, "name").agg(F.sum("hits").alias("hits"), F.min("first_at").alias("first_at"))
