"""Byte-level dedup with suffix arrays built block by block.

A shard's stretches form a block of text. Its suffixes are dealt into buckets by their first eight
bytes, and one bucket is sorted at a time: by the first 21 bytes, and where those tie by the rank
of the next suffix in a difference cover sample. Ranks of the sample are computed beforehand, by
doubling, to a depth beyond the window. Neighbours in the sorted bucket are then compared over the
whole window, so the result is exact. Each stretch is laid out with its anchor at a multiple of
the cover's period: equal windows have anchors at equal places, hence equal distances to the
sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from accountloom.llm.common import flat_ranges, text_buffer, tidy
from accountloom.llm.repeats import BUCKET_BYTES, Stretches, Units, earlier_windows

WINDOW = 50
ANCHOR = 16
PERIOD = 21
COVER = np.array([0, 1, 4, 14, 16])
"""A perfect difference set modulo 21: every difference occurs once."""
SUFFIXES = 1 << 17
"""About as many suffixes are sorted together; a bucket of equal first bytes stays whole."""


def bytes_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offs


def _eight(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as big-endian numbers."""
    two = (text[:-1].astype(np.uint64) << np.uint64(8)) | text[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks by several keys, the first one leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _sample_ranks(eight: np.ndarray, periods: int, window: int) -> np.ndarray:
    """Ranks of the sample suffixes to a depth of at least ``window``, in order of position."""
    at = (np.arange(periods)[:, None] * PERIOD + COVER).ravel()
    rank, step = _ranks([eight[at], eight[at + 8], eight[at + PERIOD - 8]]), 1
    while step * PERIOD < window:
        ahead = np.concatenate([rank[step * len(COVER):], np.full(step * len(COVER), -1)])[:len(rank)]
        rank = np.unique((rank << 32) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def sort_blocks(s: Stretches, u: Units) -> np.ndarray:
    """For every unit, the first unit of the earliest window equal to the one that starts there."""
    lead = (-s.anchors) % PERIOD
    slots = -(-(lead + s.lengths) // PERIOD)
    begin = (np.cumsum(slots) - slots) * PERIOD + lead
    periods = int(slots.sum()) + -(-(2 * u.window + PERIOD) // PERIOD)
    text = np.zeros(periods * PERIOD + 64, np.uint8)
    text[flat_ranges(begin, s.lengths)] = s.units
    eight = _eight(text)
    sample = _sample_ranks(eight, periods, u.window)
    to_next = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    which_cover = np.zeros(PERIOD, np.int64)
    which_cover[COVER] = np.arange(len(COVER))

    n = s.lengths - u.window + 1
    suffix, unit = flat_ranges(begin, n), flat_ranges(s.starts, n)
    first = np.arange(len(s.units))
    lead_bytes = eight[suffix]
    order = np.argsort(lead_bytes, kind="stable")
    edges = np.flatnonzero(np.diff(lead_bytes[order])) + 1
    lo = 0
    while lo < len(order):
        later = np.searchsorted(edges, lo + SUFFIXES)
        hi = int(edges[later]) if later < len(edges) else len(order)
        _sort_bucket(order[lo:hi], suffix, unit, eight, sample, to_next, which_cover, u.window, first)
        lo = hi
    return first


def _sort_bucket(bucket: np.ndarray, suffix: np.ndarray, unit: np.ndarray, eight: np.ndarray, sample: np.ndarray,
                 to_next: np.ndarray, which_cover: np.ndarray, window: int, first: np.ndarray) -> None:
    p = suffix[bucket]
    residue = p % PERIOD
    at = p + to_next[residue]
    tie = sample[at // PERIOD * len(COVER) + which_cover[at % PERIOD]]
    order = np.lexsort((unit[bucket], tie, residue, eight[p + PERIOD - 8], eight[p + 8], eight[p]))
    p, own = p[order], unit[bucket][order]
    same = residue[order][1:] == residue[order][:-1]
    for d in [*range(0, window - 8, 8), window - 8]:
        e = eight[p + d]
        same &= e[1:] == e[:-1]
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    # Units are in order of place, so the least unit of a group is its earliest window.
    least = np.minimum.reduceat(own, head)
    first[own] = np.repeat(least, np.diff(np.append(head, len(own))))


UNITS = Units(bytes_of, WINDOW, ANCHOR, "u1", False)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: ``id_col``, n_bytes, n_removed, spans (start and end of removed runs), kept, kept_sha256.

    Texts are UTF-8 bytes; ``window`` is at least 21. A byte goes if a string of ``window`` bytes
    over it also starts in a document with a smaller id. Strings are judged on the input and never
    cross documents. ``kept`` is binary, as a cut may fall inside a character. A null text is
    empty; a null id counts as the largest; repeated rows are one document and get equal rows;
    other columns are not read; an empty table gives an empty result.
    """
    if window < PERIOD:
        raise ValueError(f"the window must be at least {PERIOD} bytes")
    u = UNITS._replace(window=window)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            gone, whole = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for i in range(len(batch)):
                own = data[offs[i]:offs[i + 1]]
                spans, n = [], len(own)
                if whole[i] and n >= window:
                    spans = [(0, n)]
                elif gone[i] and not whole[i]:
                    mark = np.zeros(n + 1, np.int64)
                    for r in gone[i]:
                        mark[r["start"]] += 1
                        mark[r["start"] + r["n"] + window - 1] -= 1
                    out = np.cumsum(mark) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], out]).astype(np.int8)))
                    spans = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                    own = own[~out[:-1]]
                kept = b"" if spans == [(0, n)] else own.tobytes()
                rows.append((n, sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], kept,
                             hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(),
                pa.string()))]], ["id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return earlier_windows(docs, id_col, text_col, u, sort_blocks, bucket_bytes).mapInArrow(tidy(finish), f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary, "
                "kept_sha256 string").withColumnRenamed("id", id_col)
