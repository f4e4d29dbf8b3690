"""Tokenizing by segments that a tokenizer never looks across, each distinct one only once.

Both public tokenizers used here cut a text where a run of white space begins after other
characters: no token spans that place, and no rule looks past it. A text's tokens are therefore
those of its segments. Segments are hashed with numpy; known ones are answered from a table, and
unknown ones are encoded once and kept in a bounded cache of the Python worker.

ASCII white space alone is looked for. A text that holds another white-space character (no-break
space, U+2000 and so on) is encoded whole, so that the rules of the tokenizer decide.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from accountloom.llm.common import WHITE, Table, hash_spans, spans_of, text_buffer

_LOADED: dict = {}
LENGTH_BITS = 31
"""A segment's place in the pool stands above these bits, its number of ids in them: no text of an
Arrow batch has 2^31 bytes, so none has as many ids."""


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def encode(path: str, texts: list[str]) -> list[list[int]]:
    """Token ids of whole strings, without special tokens added, truncation or padding."""
    return [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def white_led(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments: white space with the other characters after it; together they cover every byte."""
    white = WHITE[data]
    start = white.copy()
    start[1:] &= ~white[:-1]
    start[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], len(data))


def bare(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments without white space, for a tokenizer that drops it."""
    return spans_of(data, offs, WHITE)


def odd_rows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that may hold white space outside ASCII."""
    if not len(data) or data.max() < 0xC2:
        return np.zeros(0, np.int64)
    a, b = data[:-1], data[1:]
    odd = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) \
        | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))
    return np.unique(np.searchsorted(offs, np.flatnonzero(odd), side="right") - 1)


class Segmented:
    """The segments of one Arrow text column."""

    def __init__(self, col: pa.Array, cut):
        self.data, self.offs = text_buffer(col)
        self.starts, self.ends = cut(self.data, self.offs)
        self.hashes = hash_spans(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offs)
        self.odd = odd_rows(self.data, self.offs)

    def strings(self, index: np.ndarray) -> list[str]:
        data = self.data
        return [data[a:b].tobytes().decode() for a, b in zip(self.starts[index].tolist(), self.ends[index].tolist())]

    def row(self, i: int) -> str:
        return self.data[self.offs[i]:self.offs[i + 1]].tobytes().decode()


class Cache:
    """What a worker has encoded so far, until it is full: counts, or ids in one pool."""

    def __init__(self, path: str, bits: int = 21, pool: int = 1 << 22):
        self.path, self.table, self.limit = path, Table(bits, np.int64), pool
        self.pool, self.used = np.empty(0, np.int32), 0

    def counts(self, seg: Segmented, hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Number of ids of segments, given by hash and by where they stand in ``seg``."""
        out = self.table.get(hashes)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            lengths = np.empty(len(new), np.int64)
            at = index[miss[first]]
            for lo in range(0, len(new), 20_000):
                lengths[lo:lo + 20_000] = [len(x) for x in encode(self.path, seg.strings(at[lo:lo + 20_000]))]
            out[miss] = lengths[back]
            if self.table.room(len(new)):
                self.table.put(new, lengths)
        return out

    def ids(self, seg: Segmented) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and the start and length in it of every segment of ``seg``."""
        where = self.table.get(seg.hashes)
        open_ = np.flatnonzero(where < 0)
        new, first, back = np.unique(seg.hashes[open_], return_index=True, return_inverse=True)
        first, kept = open_[first], self.used
        found = np.empty(len(new), np.int64)
        for lo in range(0, len(new), 20_000):
            ids = encode(self.path, seg.strings(first[lo:lo + 20_000]))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.int32, int(lengths.sum()))
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[:self.used], np.empty(max(len(flat), 1 << 20, self.used), np.int32)])
            self.pool[self.used:self.used + len(flat)] = flat
            found[lo:lo + 20_000] = ((self.used + np.cumsum(lengths) - lengths) << LENGTH_BITS) | lengths
            self.used += len(flat)
        if self.table.room(len(new)) and self.used <= self.limit:
            self.table.put(new, found)
        else:  # what came first is what is frequent: keep that, and let these be overwritten
            self.used = kept
        where[open_] = found[back]
        return self.pool, where >> LENGTH_BITS, where & ((1 << LENGTH_BITS) - 1)


def worker_cache(path: str, kind: str, **sizes: int) -> Cache:
    """The cache of this Python worker for one tokenizer file."""
    key = (path, kind)
    if key not in _LOADED:
        _LOADED[key] = Cache(path, **sizes)
    return _LOADED[key]


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each row, whose values begin at ``first``."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]
