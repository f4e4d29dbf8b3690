"""Substring dedup with automata of repeated phrases.

Passages of ``window`` words are confirmed to recur in the shard to which their anchor sends them.
The recurring ones are compiled into that shard's Aho-Corasick automaton, over word ids, with the
earliest place of each as its value; the shard's stretches, which hold every place where one of its
phrases can occur in any document, are streamed through it. Every occurrence that is not the
earliest is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from accountloom.llm.common import WHITE, flat_ranges, gram_hashes, hash_spans, spans_of, text_buffer, tidy
from accountloom.llm.repeats import BUCKET_BYTES, Stretches, Units, earlier_windows

WINDOW = 20
ANCHOR = 10


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids (32 bits of the word's hash) and the index of the first word of every row."""
    starts, ends = spans_of(data, offs, WHITE)
    return (hash_spans(data, starts, ends) >> np.uint64(32)).astype(np.uint32), np.searchsorted(starts, offs)


def locate(s: Stretches, u: Units) -> np.ndarray:
    """For every unit, the first unit of the earliest window equal to the one that starts there."""
    import ahocorasick

    first = np.arange(len(s.units))
    n = s.lengths - u.window + 1
    begin = flat_ranges(s.starts, n)
    which = np.repeat(np.arange(len(n)), n)
    hashes = gram_hashes(s.units.astype(np.uint64) + np.uint64(1), u.window)[begin]
    order = np.argsort(hashes, kind="stable")  # stable: equal windows stay in order of place
    new = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])
    group = np.cumsum(new) - 1
    recurs = np.bincount(group, weights=s.counts[which[order]])[group] > 1
    phrases = begin[order[new & recurs]]
    if not len(phrases):
        return first
    words = s.units.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in phrases.tolist():
        automaton.add_word(tuple(words[p:p + u.window]), p)
    automaton.make_automaton()
    place, owner = [], []
    back = u.window - 1
    for i in np.unique(which[order[recurs]]).tolist():
        a = int(s.starts[i])
        for end, p in automaton.iter(tuple(words[a:a + int(s.lengths[i])])):
            place.append(a + end - back)
            owner.append(p)
    first[place] = owner
    return first


UNITS = Units(words_of, WINDOW, ANCHOR, "<u4", True)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: ``id_col``, n_words, n_removed, kept (the words left, joined by one blank), kept_sha256.

    Words are runs of characters other than ASCII white space, unchanged. A word goes if a window
    of ``window`` words over it also starts earlier: in a document with a smaller id, or earlier in
    the same one. Windows are judged on the input. A null text has no words; a null id counts as
    the largest; repeated rows are one document and get equal rows; other columns are not read; an
    empty table gives an empty result.
    """
    u = UNITS._replace(window=window, gram=max(1, min(ANCHOR, window)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_buffer(batch.column(1))
            gone, whole = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for i in range(len(batch)):
                words = data[offs[i]:offs[i + 1]].tobytes().split()
                n = len(words)
                if whole[i] and n >= window:
                    words = []
                elif gone[i] and not whole[i]:
                    mark = np.zeros(n + 1, np.int64)
                    for r in gone[i]:
                        mark[r["start"]] += 1
                        mark[r["start"] + r["n"] + window - 1] -= 1
                    words = [words[j] for j in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                rows.append((n, n - len(words), kept.decode(), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.string(), pa.string()))]], ["id", "n_words", "n_removed", "kept", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return earlier_windows(docs, id_col, text_col, u, locate, bucket_bytes) \
        .mapInArrow(tidy(finish), f"id {kind}, n_words long, n_removed long, kept string, kept_sha256 string") \
        .withColumnRenamed("id", id_col)
