"""Byte-level BPE over blocks of whole texts, with the results of the tokenizers library.

Pieces are cut by vectorised classes of bytes, each distinct piece of a block is merged once (all pieces of a length side
by side, one merge each a step, lowest rank first, leftmost first), and ids are gathered back. Texts that hold the string
of a special token, or a character that Python's tables don't know (the library's may), and pieces of over LONG bytes, go
through the library itself. Where a file's normaliser composes characters, so do texts with a mark, a letter that isn't in
composed form, or a part of a syllable: the library's tables are older than Python's, so the two may disagree on them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa

from . import blocks as B

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Bytes up to which a piece is merged in arrays.
LONG = 48
NONE = np.int32(2**31 - 1)
OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 4
#: White space outside ASCII.
WIDE_SPACE = {0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}


def _kind(cp: int) -> int:
    if cp in WIDE_SPACE or cp == 0x20 or 0x09 <= cp <= 0x0D:
        return SPACE
    category = unicodedata.category(chr(cp))
    return UNKNOWN if category == "Cn" else {"L": LETTER, "N": NUMBER}.get(category[0], OTHER)


@lru_cache(maxsize=None)
def settled(char: str) -> bool:
    """Composition leaves the character as it is, whatever stands before or after it, by any edition of the tables."""
    return not (unicodedata.category(char)[0] == "M" or unicodedata.combining(char) or 0x1100 <= ord(char) < 0x1200 or unicodedata.normalize("NFC", char) != char)


ASCII = np.zeros(256, np.uint8)
ASCII[:128] = [_kind(c) for c in range(128)]


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte's character."""
    out = ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        a = data[lead].astype(np.int32)
        at = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F
        cp = np.where(a < 0xE0, (a & 0x1F) << 6 | at(1), np.where(a < 0xF0, (a & 0x0F) << 12 | at(1) << 6 | at(2), (a & 7) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        seen, which = np.unique(cp, return_inverse=True)
        kind = np.array([_kind(min(int(c), 0x10FFFF)) for c in seen], np.uint8)[which]
        out[lead] = kind
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            m = a >= least
            out[lead[m] + k] = kind[m]
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces, and which documents hold characters of no known kind. spaced: a space belongs to what follows it and white space is kept; else it is dropped and digits stand alone."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = kinds(data)
    strange = np.unique(np.searchsorted(offsets, np.flatnonzero(kind == UNKNOWN), "right") - 1)
    edge = np.empty(n, bool)  # where a run of one kind, or a document, starts
    edge[0] = True
    edge[1:] = kind[1:] != kind[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    edge[first] = True
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    cut = edge.copy()
    runs = np.flatnonzero(edge)
    if not spaced:
        digits = (kind == NUMBER) & ((data & 0xC0) != 0x80)
        cut |= digits
    else:
        solid = runs[(kind[runs] != SPACE) & ~begins[runs]]
        before = solid[kind[solid - 1] == SPACE]
        plain = data[before - 1] == 0x20
        cut[before[plain]] = False
        last = before - 1
        for _ in range(3):
            last = last - ((data[last] & 0xC0) == 0x80)
        cut[last] = True
    # an apostrophe by itself and the letters after it
    if (quote := np.flatnonzero(edge & (data == 0x27))).size:
        quote = quote[quote + 1 < n]
        quote = quote[edge[quote + 1] & ~begins[quote + 1] & (kind[quote + 1] == LETTER)]
        if spaced:
            quote = quote[begins[quote] | (data[quote - 1] != 0x20)]
        if quote.size:
            a = data[quote + 1]
            two = np.minimum(quote + 2, n - 1)
            b = np.where((quote + 2 < n) & ~begins[quote + 2], data[two], 0)
            size = np.where(np.isin(a, list(b"stmd")), 1, np.where(((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108), 2, 0))
            quote, size = quote[size > 0], size[size > 0]
            cut[quote + 1] = False
            after = quote + 1 + size
            inside = after < n
            after = after[inside]
            after = after[~begins[after] & ((kind[after] == LETTER))]
            cut[after] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    if not spaced:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends, strange


class Bpe:
    """spec: a tokenizer file. ids are those of the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.spaced = not self.suffix
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.rare = re.compile(b"|".join(map(re.escape, self.special))) if self.special else None
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        others = [b for b in range(256) if b not in letters]
        self.sign = {b: chr(b) for b in letters} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.first = np.array([vocab[self.sign[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[self.sign[b] + self.suffix] for b in range(256)], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.keys, self.ranks = self._table([(vocab[a] << 16) | vocab[b] for a, b in merges])
        back = {v: k for k, v in self.sign.items()}
        size = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        names = [b""] * size
        for s, i in vocab.items():
            names[i] = bytes(back[c] for c in s.removesuffix(self.suffix) if c in back) if self.suffix else bytes(back[c] for c in s if c in back)
        for t in spec["added_tokens"]:
            names[t["id"]] = t["content"].encode()
        self.name_len = np.array([len(x) for x in names], np.int64)
        self.name_at = np.concatenate([[0], np.cumsum(self.name_len)[:-1]])
        self.name_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.lexicon = None

    @cached_property
    def library(self) -> "Tokenizer":
        """Loaded where a text needs it only."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    @cached_property
    def plain_library(self) -> "Tokenizer":
        """One to which strings of special tokens are text like any other."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.library.to_str())
        out.encode_special_tokens = True
        return out

    @staticmethod
    def _table(keys: list[int], bits: int = 18) -> tuple[np.ndarray, np.ndarray]:
        table, rank = np.full(1 << bits, 0xFFFFFFFF, np.uint32), np.full(1 << bits, NONE, np.int32)
        for r, k in enumerate(keys):
            at = ((k * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - bits)
            while table[at] != 0xFFFFFFFF:
                at = (at + 1) & ((1 << bits) - 1)
            table[at], rank[at] = k, r
        return table, rank

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE."""
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = (key * np.uint32(0x9E3779B1)) >> np.uint32(14)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], NONE)
        todo = np.nonzero((found != key) & (found != 0xFFFFFFFF))
        while len(todo[0]):
            at[todo] = (at[todo] + np.uint32(1)) & np.uint32(0x3FFFF)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[tuple(t[hit] for t in todo)] = self.ranks[at[todo]][hit]
            more = ~hit & (found != 0xFFFFFFFF)
            todo = tuple(t[more] for t in todo)
        return out

    def _merge(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids of one length each, merged: ids, and how many of them count."""
        n, width = m.shape
        out, count = m.copy(), np.full(n, width)
        rows, live = np.arange(n), m
        r = self.rank(m[:, :-1], m[:, 1:]) if width > 1 else None
        while width > 1 and len(rows):
            p = r.argmin(1)
            best = r[np.arange(len(rows)), p]
            go = best != NONE
            if not go.all():
                stop = rows[~go]
                out[stop, :width], count[stop] = live[~go], width
                rows, live, r, p, best = rows[go], live[go], r[go], p[go], best[go]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            live[k, p] = self.made[best]
            span = np.arange(width)
            live = live[span != (p + 1)[:, None]].reshape(len(rows), width - 1)
            r = r[span[:-1] != p[:, None]].reshape(len(rows), width - 2)
            width -= 1
            if width > 1:
                i = np.flatnonzero(p > 0)
                r[i, p[i] - 1] = self.rank(live[i, p[i] - 1], live[i, p[i]])
                i = np.flatnonzero(p < width - 1)
                r[i, p[i]] = self.rank(live[i, p[i]], live[i, p[i] + 1])
        if len(rows):
            out[rows, :width], count[rows] = live, width
        return out, count

    def distinct(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces that lie one after the other in data, and how many each has; known words come from the lexicon, the rest is merged."""
        length = np.diff(offsets)
        n = len(length)
        count, parts = np.zeros(n, np.int64), []
        todo = np.arange(n)
        if self.lexicon is not None:
            word = self.lexicon.find(data, offsets)
            known = np.flatnonzero(word >= 0)
            todo = np.flatnonzero(word < 0)
            if len(known):
                count[known] = self.lexicon.counts(word[known])
                parts.append((known, None, word[known]))
        todo = todo[np.argsort(length[todo], kind="stable")]
        sizes, at = np.unique(length[todo], return_index=True)
        for size, a, z in zip(sizes, at, np.append(at[1:], len(todo))[: len(sizes)], strict=True):
            rows = todo[a:z]
            if size <= LONG:
                block = data[offsets[rows][:, None] + np.arange(size)]
                m = self.first[block]
                m[:, -1] = self.last[block[:, -1]]
                ids, c = self._merge(m)
            else:
                found = [[t.id for t in self.library.model.tokenize("".join(self.sign[b] for b in data[offsets[i] : offsets[i + 1]].tolist()))] for i in rows]
                c = np.array([len(x) for x in found])
                ids = np.zeros((len(rows), c.max()), np.int32)
                for k, x in enumerate(found):
                    ids[k, : len(x)] = x
            count[rows] = c
            parts.append((rows, ids, c))
        start = np.concatenate([[0], np.cumsum(count)[:-1]]) if n else np.zeros(0, np.int64)
        flat = np.zeros(int(count.sum()), np.int32)
        for rows, ids, c in parts:
            if ids is None:
                flat[B.ragged(start[rows], count[rows])] = self.lexicon.ids(c)
            else:
                flat[B.ragged(start[rows], c)] = ids[np.arange(ids.shape[1]) < c[:, None]]
        return flat, count

    def normalised(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the file's normaliser makes of the texts, as far as pieces can tell."""
        if self.spaced:
            return data, offsets
        if not (data >= 0x80).any():
            return B.LOWER[data], offsets
        out = []
        for a, z in zip(offsets[:-1], offsets[1:], strict=True):
            raw = data[a:z].tobytes()
            if raw.isascii():
                out.append(raw.lower())
                continue
            text = raw.decode("utf-8", "replace")
            if all(map(settled, set(text))):
                # each character by itself: a final sigma is no exception here
                out.append(text.replace("Σ", "σ").lower().encode())
            else:
                out.append(self.library.normalizer.normalize_str(text).encode())
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes, their pieces' starts and ends, each document's first piece (n + 1), and the documents that only the library can cut."""
        data, offsets = self.normalised(data, offsets)
        starts, ends, strange = pieces(data, offsets, self.spaced)
        return data, starts, ends, np.searchsorted(starts, offsets), strange

    def encode(self, data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents one after the other (int32), and how many each has. plain: strings of special tokens are text like any other."""
        raw = data
        n = len(offsets) - 1
        data, starts, ends, first, strange = self.cut(data, offsets)
        odd = sorted({*([] if plain else self._with_special(raw, offsets)), *strange.tolist()})
        length = ends - starts
        packed = data if self.spaced else data[B.ragged(starts, length)]
        which, words = B.codes(packed, length)
        wdata, woff = B.buffers(words)
        flat, count = self.distinct(wdata, woff)
        at = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.zeros(0, np.int64)
        per = count[which]
        ids = flat[B.ragged(at[which], per)]
        total = np.concatenate([[0], np.cumsum(per)])
        counts = np.diff(total[first])
        if odd:
            ends_ = np.concatenate([[0], np.cumsum(counts)])
            parts = [ids[ends_[i] : ends_[i + 1]] for i in range(n)]
            for i in odd:
                text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                parts[i] = np.array((self.plain_library if plain else self.library).encode(text, add_special_tokens=False).ids, np.int32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    def _with_special(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Documents in which the library finds special tokens."""
        if self.rare is None:
            return []
        return sorted({int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self.rare.finditer(memoryview(np.ascontiguousarray(data)))})

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all documents and their offsets (before any repair of broken UTF-8)."""
        size = self.name_len[ids]
        out = self.name_bytes[B.ragged(self.name_at[ids], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return out, total[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def batch_texts(batch: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    return B.buffers(batch.column(text))
