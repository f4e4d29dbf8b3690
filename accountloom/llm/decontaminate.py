"""Benchmark decontamination: a prefix-filtered set join of item windows with all documents.

An item's window is ten consecutive words, or the whole item if it has fewer. A window can only
occur where all of its shingles (up to three words) do, so its prefix is one shingle: the rarest
one over all documents. Only prefixes are looked up in documents. A hit fixes where the window
would start; it must lie within the document, and its words are then compared one by one.

The benchmark is a stated set of queries. It is cut into blocks of at most ``BLOCK_WINDOWS``
windows, and each block is broadcast and held against all documents, so the broadcast has a fixed
bound however large the benchmark is. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.llm.common import (
    ALNUM_BREAK, LOWER, Table, prepare, flat_ranges, gram_hashes, hash_spans, mix, pieces, spans_of,
    text_buffer, tidy)

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS = 1 << 17


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the index of the first word of every row."""
    data = LOWER[data]
    starts, ends = spans_of(data, offs, ALNUM_BREAK)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offs)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words, told apart by size."""
    return mix(gram_hashes(words, size) + np.uint64(size))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item string, words array<long>): every window of every item as word hashes, null ids as ''."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, first = word_hashes(*text_buffer(batch.column(1)))
            ids, out = batch.column(0).to_pylist(), {"item": [], "words": []}
            for i, item in enumerate(ids):
                own = words[first[i]:first[i + 1]].view(np.int64)
                for at in range(max(1, len(own) - window + 1) if len(own) else 0):
                    out["item"].append(item)
                    out["words"].append(own[at:at + window])
            yield pa.record_batch([pa.array(out["item"], pa.string()), pa.array(out["words"], pa.list_(pa.int64()))],
                                  ["item", "words"])

    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")) \
        .mapInArrow(tidy(cut), "item string, words array<bigint>").distinct()


class Block:
    """Windows of one block: distinct word sequences, their items, and every shingle in them."""

    def __init__(self, rows: list, window: int):
        found: dict[tuple, set] = {}
        for r in rows:
            found.setdefault(tuple(r.words), set()).add(r.item)
        kept = sorted(found)
        self.window, self.items = window, [sorted(found[k]) for k in kept]
        self.length = np.array([len(k) for k in kept], np.int64)
        self.words = np.zeros((len(kept), window), np.uint64)
        for i, k in enumerate(kept):
            self.words[i, :len(k)] = np.array(k, np.int64).view(np.uint64)
        keys, of, at, size = [], [], [], []
        for i in range(len(kept)):
            k = min(SHINGLE, int(self.length[i]))
            h = shingles(self.words[i, :self.length[i]], k)
            keys += h.tolist()
            of += [i] * len(h)
            at += range(len(h))
            size += [k] * len(h)
        self.keys, back = np.unique(np.array(keys, np.uint64), return_inverse=True)
        self.of, self.at, self.key = np.array(of, np.int64), np.array(at, np.int64), back
        self.sizes = sorted(set(size))
        self.table = table_of(self.keys)

    def keep_rarest(self, seen: np.ndarray) -> None:
        """Leave one shingle per window, the one seen least, as its prefix."""
        order = np.lexsort((self.at, self.keys[self.key], seen[self.key], self.of))
        first = order[np.unique(self.of[order], return_index=True)[1]]
        keys, back = np.unique(self.key[first], return_inverse=True)
        by = np.argsort(back, kind="stable")
        self.prefix_of, self.prefix_at = self.of[first][by], self.at[first][by]
        self.group = np.searchsorted(back[by], np.arange(len(keys) + 1))
        self.table = table_of(self.keys[keys])
        self.keys = self.of = self.at = self.key = None


def table_of(keys: np.ndarray) -> Table:
    table = Table(max(4, (4 * len(keys) + 1).bit_length()), np.int32)
    table.put(keys, np.arange(len(keys), dtype=np.int32))
    return table


def shingle_counts(docs: DataFrame, text_col: str, shared) -> np.ndarray:
    """How often each shingle of a block occurs over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        total = np.zeros(len(block.keys), np.int64)
        for batch in batches:
            data, offs = text_buffer(batch.column(0))
            for lo, hi in pieces(offs):
                words, _ = word_hashes(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                for k in block.sizes:
                    hit = block.table.get(shingles(words, k))
                    total += np.bincount(hit[hit >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int64)), pa.array(total[some])], ["k", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(count), "k long, n long") \
        .groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(shared.value.keys), np.int64)
    for r in rows:
        out[r.k] = r.n
    return out


def occurrences(words: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and window number of every occurrence of a block's windows in some rows."""
    rows, starts, windows = ([np.zeros(0, np.int64)] for _ in range(3))
    for k in block.sizes:
        hit = block.table.get(shingles(words, k))
        pos = np.flatnonzero(hit >= 0)
        group = hit[pos]
        n = block.group[group + 1] - block.group[group]
        cand = flat_ranges(block.group[group], n)
        win, start = block.prefix_of[cand], np.repeat(pos, n) - block.prefix_at[cand]
        row = np.searchsorted(first, np.repeat(pos, n), side="right") - 1
        length = block.length[win]
        ok = (np.minimum(length, SHINGLE) == k) & (start >= first[row]) & (start + length <= first[row + 1])
        win, start, row, length = win[ok], start[ok], row[ok], length[ok]
        for j in range(block.window):
            ok = (j >= length) | (words[np.minimum(start + j, len(words) - 1)] == block.words[win, j])
            win, start, row, length = win[ok], start[ok], row[ok], length[ok]
        rows.append(row)
        starts.append(start)
        windows.append(win)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(windows)


def _scan(docs: DataFrame, shared, kind: str) -> DataFrame:
    """(id, same, n_words, runs, items): hit runs of words as start and end, packed in pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            data, offs = text_buffer(batch.column(2))
            n_words, runs, items = [], [], []
            for lo, hi in pieces(offs):
                words, first = word_hashes(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                row, start, win = occurrences(words, first, block)
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + block.length[win], -1)
                hit = np.concatenate([[False], np.cumsum(mark)[:-1] > 0, [False]])
                begin = np.flatnonzero(hit[1:] & ~hit[:-1])
                end = np.flatnonzero(~hit[1:] & hit[:-1])
                # A run may go on into the next row: cut it there.
                inner = first[1:-1]
                inner = np.unique(inner[(inner > 0) & (inner < len(words))])
                inner = inner[hit[inner] & hit[inner + 1]]
                begin, end = np.union1d(begin, inner), np.union1d(end, inner)
                at = np.searchsorted(begin, first)
                found: list[set] = [set() for _ in range(hi - lo)]
                pairs = np.unique(row * len(block.items) + win)
                for r, w in zip((pairs // len(block.items)).tolist(), (pairs % len(block.items)).tolist()):
                    found[r].update(block.items[w])
                n_words += np.diff(first).tolist()
                for i in range(hi - lo):
                    own = np.stack([begin[at[i]:at[i + 1]], end[at[i]:at[i + 1]]], 1) - first[i]
                    runs.append(own.astype("<i8").tobytes())
                    items.append(sorted(found[i]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                                   pa.array(runs, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                                  ["id", "same", "n_words", "runs", "items"])

    return docs.mapInArrow(tidy(run), f"id {kind}, same long, n_words long, runs binary, items array<string>")


def blocks(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str,
           window: int, block_windows: int) -> Iterator[Block]:
    """The blocks of a benchmark, at least one, with prefixes chosen by counts over all documents."""
    prepare(spark)
    windows = item_windows(items, item_col, item_text_col, window)
    n_blocks = max(1, -(-windows.count() // block_windows))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(n_blocks)))
    for b in range(n_blocks):
        block = Block(numbered.where(F.col("block") == b).select("item", "words").collect(), window)
        shared = spark.sparkContext.broadcast(block)
        block.keep_rarest(shingle_counts(docs, text_col, shared))
        shared.unpersist()
        yield block


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: ``id_col``, n_words, hits (runs of hit words, start and end) and items.

    Words are lower-cased runs of letters, digits and bytes above ASCII. A null text and a null
    item text have no words; a null item id reads ''; a null document id is kept; repeated rows
    give repeated rows; other columns are not read; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    scans = [_scan(rows, spark.sparkContext.broadcast(block), kind) for block in blocks(
        spark, docs, items, text_col, item_col, item_text_col, window, block_windows)]
    n_blocks, parts = len(scans), scans[0]
    for scan in scans[1:]:
        parts = parts.unionAll(scan)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs in batch.column(1).to_pylist():
                own = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 2) for x in runs])
                own = own[np.lexsort((own[:, 1], own[:, 0]))]
                if len(own):
                    reach = np.maximum.accumulate(own[:, 1])
                    new = np.concatenate([[True], own[1:, 0] > reach[:-1]])
                    begin = np.flatnonzero(new)
                    own = np.stack([own[begin, 0], reach[np.append(begin[1:], len(own)) - 1]], 1)
                out.append([{"start": int(a), "end": int(b)} for a, b in own])
            kind_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), batch.column(4),
                                   pa.array(out, kind_)], ["id", "n_words", "items", "times", "hits"])

    joined = parts.groupBy("id", "same", "n_words").agg(
        F.collect_list("runs").alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        (F.count("*") / n_blocks).cast("long").alias("times"))
    return joined.select("id", "runs", "n_words", F.array_sort("items").alias("items"), "times").mapInArrow(tidy(merge), f"id {kind}, n_words long, items array<string>, times long, hits array<struct<start:bigint,end:bigint>>") \
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))) \
        .select(F.col("id").alias(id_col), "n_words", "hits", "items")


def without_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window of any item.

    The blocks of the benchmark are applied one after the other, each in one scan without a shuffle.
    """
    spark = docs.sparkSession
    for block in blocks(spark, docs, items, text_col, item_col, item_text_col, window, block_windows):
        shared = spark.sparkContext.broadcast(block)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offs = text_buffer(batch.column(at))
                clean = np.ones(len(batch), bool)
                for lo, hi in pieces(offs):
                    words, first = word_hashes(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                    clean[lo + occurrences(words, first, shared.value)[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
