"""BPE encoding and decoding by a minimal acyclic transducer over frequent words.

The corpus's frequent pieces (counted over all texts) are compiled into one automaton whose common suffixes are shared.
Each transition carries how many words sort before those it leads to, so the sum along a path is the word's number,
which points at its ids. The automaton lies in a file that executors fetch once and map into memory; a piece that it
doesn't accept is merged exactly. So ids never depend on which words it holds.

Defined cases: a null text is the empty one, with no ids; texts of any length are worked on whole; an empty table makes
an empty automaton; repeated rows are encoded alike; other columns of any name come along unchanged in `row`.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import bpe
from .scratch import materialise, new_path, write_bytes

#: Words in the automaton.
WORDS = 1 << 15


def counts(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """word, n: pieces of all texts (longer ones than LONG are never looked up), and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(tokenizer)
        for block in B.gathered(batches, "text", B.BLOCK_BYTES):
            data, starts, ends, *_ = coder.cut(*B.buffers(block.column("text")))
            packed = data if coder.spaced else data[B.ragged(starts, ends - starts)]
            which, words = B.codes(packed, ends - starts)
            n = np.bincount(which, minlength=len(words))
            keep = np.flatnonzero(np.diff(B.buffers(words)[1]) <= bpe.LONG)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(keep)).cast(pa.binary()), pa.array(n[keep])], ["word", "n"])

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_words(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The automaton's file. words: distinct, in any order; ids of each."""
    order = sorted(range(len(words)), key=words.__getitem__)
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # of the last word: parent, byte, state; not yet minimised

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, state = path.pop()
            same = (final[state], tuple(edges[state].items()))
            edges[parent][byte] = register.setdefault(same, state)

    last = b""
    for i in order:
        word = words[i]
        common = len(os.path.commonprefix([last, word]))
        settle(common)
        at = path[-1][2] if path else 0
        for byte in word[common:]:
            edges.append({})
            final.append(False)
            new = len(edges) - 1
            edges[at][byte] = new
            path.append((at, byte, new))
            at = new
        final[at] = True
        last = word
    settle(0)
    below: dict[int, int] = {}

    def size(state: int) -> int:
        stack = [state]
        while stack:
            s = stack[-1]
            if s in below:
                stack.pop()
                continue
            todo = [t for t in edges[s].values() if t not in below]
            if todo:
                stack += todo
            else:
                below[s] = final[s] + sum(below[t] for t in edges[s].values())
                stack.pop()
        return below[state]

    size(0)
    live = {s: k for k, s in enumerate(sorted(below))}
    number_edges = [(live[s] << 8 | byte, live[t], before) for s in live for byte, t, before in _outputs(edges[s], final[s], below)]
    bits = max(4, (2 * len(number_edges)).bit_length())
    keys = np.full(1 << bits, -1, np.int64)
    target, before = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
    for key, t, n in number_edges:
        at = ((key * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits)
        while keys[at] >= 0:
            at = (at + 1) & ((1 << bits) - 1)
        keys[at], target[at], before[at] = key, t, n
    ends = np.array([final[s] for s in sorted(below)], np.int32)
    flat = np.array([x for i in order for x in ids[i]], np.int32)
    first = np.concatenate([[0], np.cumsum([len(ids[i]) for i in order])]).astype(np.int64)
    head = np.array([bits, len(ends), len(first), len(flat)], np.int64)
    return b"".join(x.tobytes() for x in (head, keys, first, target, before, ends, flat))


def _outputs(edges: dict[int, int], final: bool, below: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    before = int(final)
    for byte in sorted(edges):
        yield byte, edges[byte], before
        before += below[edges[byte]]


class Lexicon:
    """A compiled automaton, mapped into memory."""

    def __init__(self, path: str):
        self.bits, states, words, total = (int(x) for x in np.fromfile(path, np.int64, 4))
        at, size = 32, 1 << self.bits

        def part(kind: type, n: int) -> np.ndarray:
            nonlocal at
            out = np.memmap(path, kind, "r", at, n) if n else np.zeros(0, kind)
            at += n * np.dtype(kind).itemsize
            return out

        self.keys, self.first = part(np.int64, size), part(np.int64, words)
        self.target, self.before, self.final, self.flat = part(np.int32, size), part(np.int32, size), part(np.int32, states), part(np.int32, total)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each word's number, or -1."""
        length = np.diff(offsets)
        state, number = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        live = np.flatnonzero((length > 0) & (length <= bpe.LONG))
        out = np.full(len(length), -1, np.int64)
        mask, shift, step = np.int64((1 << self.bits) - 1), np.uint32(32 - self.bits), 0
        while len(live):
            key = state[live] << 8 | data[offsets[live] + step]
            at = ((key.astype(np.uint32) * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)
            found = self.keys[at]
            while True:
                probe = np.flatnonzero((found != key) & (found >= 0))
                if not len(probe):
                    break
                at[probe] = (at[probe] + 1) & mask
                found[probe] = self.keys[at[probe]]
            hit = found == key
            live, at = live[hit], at[hit]
            state[live] = self.target[at]
            number[live] += self.before[at]
            step += 1
            done = length[live] == step
            ended = live[done]
            ended = ended[self.final[state[ended]] > 0]
            out[ended] = number[ended]
            live = live[~done]
        return out

    def counts(self, word: np.ndarray) -> np.ndarray:
        return self.first[word + 1] - self.first[word]

    def ids(self, word: np.ndarray) -> np.ndarray:
        return self.flat[B.ragged(self.first[word], self.counts(word))]


def build(df: DataFrame, tokenizer: str, text: str = "text", words: int = WORDS) -> str:
    """Counts all texts' words, compiles the most frequent, and gives every executor the file. Returns its name."""
    spark = df.sparkSession
    found = materialise(counts(df, tokenizer, text).withColumn("step", F.floor(F.log2("n") * 8).cast("int")), "word-counts")
    # the least step of counts above which there are no more than `words` words: of any corpus, a few hundred rows and those words come here
    steps, least, room = found.groupBy("step").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("step")).collect(), 1 << 30, words
    for r in steps:
        room -= r.k
        if room < 0:
            break
        least = r.step
    top = sorted(bytes(r.word) for r in found.where(F.col("step") >= least).select("word").collect())
    coder = bpe.Bpe(tokenizer)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in top])]).astype(np.int64)
    flat, n = coder.distinct(np.frombuffer(b"".join(top), np.uint8), offsets)
    ends = np.concatenate([[0], np.cumsum(n)]).astype(int)
    path = new_path(spark, "lexicon") + ".fsa"
    write_bytes(spark, path, compile_words(top, [flat[a:z].tolist() for a, z in zip(ends[:-1], ends[1:], strict=True)]))
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


@lru_cache(maxsize=2)
def coder_with(tokenizer: str, lexicon: str) -> bpe.Bpe:
    coder = bpe.Bpe(tokenizer)
    coder.lexicon = Lexicon(lexicon if os.path.isabs(lexicon) else SparkFiles.get(lexicon))
    return coder


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", lexicon: str | None = None) -> DataFrame:
    """For each row: key, ids (little-endian unsigned 32-bit), n_tokens."""
    lexicon = lexicon or build(df, tokenizer, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_with(tokenizer, lexicon)
        for block in B.blocks(batches, "text", B.BLOCK_BYTES // 2):
            ids, count = coder.encode(*B.buffers(block.column("text")))
            yield pa.RecordBatch.from_arrays([block.column("key"), ids_column(ids, count), pa.array(count)], ["key", "ids", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, ids binary, n_tokens long").withColumnRenamed("key", key)


def ids_column(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return B.binary_of(ids.astype("<u4").view(np.uint8), count * 4).cast(pa.binary())


def decode(df: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """df's rows with `decoded`, the text that the library's decode(ids, skip_special_tokens=False) gives."""
    others = [c for c in df.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(tokenizer)
        for block in B.blocks(batches, ids, B.BLOCK_BYTES // 2):
            data, offsets = B.buffers(block.column(ids))
            out, ends = coder.decode(data.view("<u4").astype(np.int64), np.diff(offsets) // 4)
            texts = B.binary_of(out, np.diff(ends))
            try:
                texts = texts.cast(pa.string())
            except pa.ArrowInvalid:  # ids that no text encodes to
                texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in others), texts], [*others, "decoded"])

    schema = T.StructType([*(df.schema[c] for c in others), T.StructField("decoded", T.StringType())])
    return df.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(run, schema)
