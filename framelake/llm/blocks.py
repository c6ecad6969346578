"""Whole texts as flat byte arrays: blocks of bounded size, words, and word codes, all vectorised."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once. A longer single text is a block of its own.
BLOCK_BYTES = 4 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_array(column: pa.Array) -> pa.Array:
    """Nulls become empty texts; offsets of 64 bits."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column (nulls empty) and its offsets, from 0."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = text_array(column)
    else:
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, or one row."""
    for batch in batches:
        n = batch.num_rows
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, below = 0, 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, below + limit, "right")))
            yield batch.slice(at, to - at)
            pa.default_memory_pool().release_unused()  # what a block took goes back before the next
            at, below = to, int(ends[to - 1])


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Like blocks(), and small batches are put together up to the limit."""
    held, size = [], 0
    for piece in blocks(batches, text, limit):
        own = int(pc.sum(pc.binary_length(piece.column(text))).as_py() or 0)
        if held and size + own > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if piece.num_rows:
            held.append(piece)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def binary_of(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column over bytes that lie one after the other."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+: starts, ends, the words' bytes without what is between, and each document's first word (n + 1)."""
    solid = ~WHITE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    after[:-1] = solid[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, data[solid], np.searchsorted(starts, offsets)


def codes(packed: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word's number among the block's distinct words, and those words."""
    found = binary_of(packed, lengths).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number of 64 bits for each byte, and the odd base of the sums below.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD1342543DE82EF95)


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word: the sum over its bytes of a number of the byte times a power of BASE, mixed."""
    data, offsets = buffers(distinct)
    length = np.diff(offsets)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max(initial=0)), BASE)]))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], length)
    total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[data] * power[place])])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + length.astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, in order; one shorter by n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = mix(h[: len(h) - n + 1] + np.uint64(0x9E3779B97F4A7C15))
    for k in range(1, n):
        out = mix(out * np.uint64(3) + h[k : len(h) - n + 1 + k])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... (counts[i] of them), for all i."""
    total = int(counts.sum())
    shift = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=shift[1:])
    return np.repeat(starts - shift, counts) + np.arange(total)
