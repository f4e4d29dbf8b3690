"""Vectorised scanning of Arrow text columns, shared by the operators of this subpackage.

Texts arrive in Arrow batches inside Spark tasks. Words are found and hashed with numpy over the
UTF-8 bytes; a block of at most ``BLOCK`` bytes (or one longer word) is worked on at a time, so
memory is a few times the batch, whatever the length of one text.
"""

from __future__ import annotations

import ctypes
import inspect
import math
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
PIECE = 2 << 20
"""Bytes of text that are turned into word arrays together; one longer text is taken alone."""

_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

ALNUM_BREAK = np.ones(256, bool)
ALNUM_BREAK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, for exponents 0 to n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(BLOCK, n) + 1
        have = tuple(
            np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64)
            for b in (base, pow(base, -1, 1 << 64)))
        if size <= 4 * BLOCK:
            _POWERS[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold at most ``limit`` bytes together, or one longer row each."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def spans_of(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word: a run of bytes that ``breaks`` does not mark, within one row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~breaks[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; spans stand in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        block = data[base:ends[hi - 1]]
        up, down = _powers(_P, len(block))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[:len(block)], out=sums[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(_Q)
        lo = hi
    return mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive word hashes; rows are not kept apart."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, BLOCK):
        part = words[lo:lo + BLOCK + k - 1]
        up, down = _powers(_P, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[lo:lo + m] = (sums[k:k + m] - sums[:m]) * down[:m]
    return mix(out)


class Table:
    """A fixed-size open-addressing table from 64-bit hashes to integers, in two numpy arrays.

    Its memory is fixed: ``room`` tells whether more hashes fit.
    """

    def __init__(self, bits: int, dtype: type = np.int64):
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, dtype)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The value of every hash, -1 where it is unknown."""
        slots, mask = self._slots(hashes), (1 << self.bits) - 1
        found = self.keys[slots]
        out = np.where(found == hashes, self.values[slots], self.values.dtype.type(-1))
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & mask
            found = self.keys[slots[open_]]
            hit = found == hashes[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out

    def room(self, n: int) -> bool:
        return 2 * (self.used + n) <= len(self.keys)

    def put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Add distinct unknown hashes; the caller has seen to it that there is room."""
        slots, mask, open_ = self._slots(hashes), (1 << self.bits) - 1, np.arange(len(hashes))
        self.used += len(hashes)
        while len(open_):
            free = self.keys[slots[open_]] == 0
            self.keys[slots[open_[free]]] = hashes[open_[free]]
            done = self.keys[slots[open_]] == hashes[open_]
            self.values[slots[open_[done]]] = values[open_[done]]
            open_ = open_[~done]
            slots[open_] = (slots[open_] + 1) & mask


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges that begin at ``starts``, one range after the other."""
    total = int(lengths.sum())
    begin = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(starts) else starts
    return np.arange(total, dtype=np.int64) + begin


_LIBC = ctypes.CDLL(None)
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def prepare(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and keep their Arrow batches small.

    The package goes to the executors as a zip file, once per application. Batches are bounded in
    bytes, whatever the length of the texts. The shuffle files of a query go when it ends; else they
    stay until the driver happens to collect its garbage, and those of many steps add up.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.TemporaryDirectory()  # on the driver, which serves the file while it runs
    target = Path(folder.name) / f"{root.name}-{context.applicationId}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED[context.applicationId] = folder


def give_back() -> None:
    """Return freed memory of a Python process to the system: idle workers and the driver stay for a while."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over batches or tables of a task that gives memory back when it is done."""
    if inspect.isgeneratorfunction(run):
        def over_batches(batches):
            yield from run(batches)
            give_back()

        return over_batches

    def over_table(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return over_table


def buckets_for(total: int, each: int) -> int:
    """How many buckets hold ``total`` units at about ``each`` units per bucket."""
    return max(1, math.ceil(total / each))


def text_bytes(column: str | Column) -> Column:
    """UTF-8 length of a text; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(column) if isinstance(column, str) else column), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
