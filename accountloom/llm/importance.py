"""Importance resampling towards a target: hashed word runs, counted and scored by automaton scans.

Distinct words, each bounded by delimiters, are the patterns of an Aho-Corasick automaton, and carry
their CRC-32 and their length. A text, with every other character turned into one delimiter, is run
through it; each word emits its payload, so no word is hashed twice by a worker. The CRC of a run of
words follows from the payloads of its words alone, since a CRC of joined strings is a linear
function of the parts' CRCs and lengths. CRC modulo the number of buckets is a feature.

A worker's automaton has at most ``WORDS`` words, those it met first, which are mostly the frequent
ones. What it lacks in a piece of text gets an automaton of its own for that piece. So memory is
bounded, every word is counted, and results do not depend on the dictionary.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountloom.llm.common import ALNUM_BREAK, LOWER, pieces, prepare, spans_of, text_buffer, tidy
from accountloom.session import work_path

BUCKETS = 10_000
WORDS = 1 << 16
LONGEST = 64
"""Longer words are no patterns; their CRC is taken directly, so that an automaton's size is bounded."""
SCAN = 1 << 20
"""Bytes of text that are scanned together; a row may go on in the next piece."""
SPACE = 0x20


class Dictionary:
    """The words of one Python worker as patterns; it is compiled anew whenever it has doubled."""

    def __init__(self, words: int = WORDS):
        self.limit, self.known, self.waiting, self.compiled = words, {}, {}, None

    def learn(self, found: dict[str, int]) -> None:
        """Take up new words while there is room."""
        room = self.limit - len(self.known) - len(self.waiting)
        if room > 0:
            self.waiting.update(list(found.items())[:room])
        if self.waiting and (len(self.waiting) >= len(self.known) or len(self.known) + len(self.waiting) >= self.limit):
            self.known.update(self.waiting)
            self.waiting = {}
            self.compiled = automaton(self.known)


def automaton(payloads: dict[str, int]):
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_ANY)  # its own integers have 32 bits only
    for word, payload in payloads.items():
        out.add_word(f" {word} ", payload)
    out.make_automaton()
    return out


_WORKER: dict[int, Dictionary] = {}


def scan(compiled, text: str) -> np.ndarray:
    """(end, payload) of every pattern in the text; the end is that of the delimiter after the word."""
    return np.fromiter(chain.from_iterable(compiled.iter(text)), np.int64).reshape(-1, 2)


def payloads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, held: Dictionary) -> np.ndarray:
    """The payload of each word: its CRC-32, and its length above 32 bits.

    ``data`` has lower-case words with a delimiter before and after each of them.
    """
    out = np.full(len(starts), -1, np.int64)
    text = data.tobytes().decode("latin-1")  # one character per byte

    def emit(compiled) -> None:
        hits = scan(compiled, text)
        out[np.searchsorted(ends, hits[:, 0])] = hits[:, 1]

    if held.compiled is not None:
        emit(held.compiled)
    open_ = np.flatnonzero(out < 0)
    lengths = ends - starts
    for i in open_[lengths[open_] > LONGEST].tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]]) | int(lengths[i]) << 32
    short = open_[lengths[open_] <= LONGEST]
    if len(short):
        missing = {text[a:b] for a, b in zip(starts[short].tolist(), ends[short].tolist())}
        found = {w: zlib.crc32(w.encode("latin-1")) | len(w) << 32 for w in sorted(missing)}
        emit(automaton(found))
        held.learn(found)
    return out


def word_payloads(col: pa.Array, held: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of all words of a text column, and the index of the first word of each row."""
    data, offs = text_buffer(col)
    data = LOWER[data]
    starts, ends = spans_of(data, offs, ALNUM_BREAK)
    first = np.searchsorted(starts, offs)
    out = np.empty(len(starts), np.int64)
    # Words that end within SCAN bytes of the first are scanned together, across rows; a longer word alone.
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SCAN, side="right")))
        sizes = ends[lo:hi] - starts[lo:hi]
        own = data[starts[lo]:ends[hi - 1]]
        inside = np.zeros(len(own) + 1, np.int8)
        np.add.at(inside, starts[lo:hi] - starts[lo], 1)
        np.add.at(inside, ends[lo:hi] - starts[lo], -1)
        letters = own[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        begin = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        spaced = np.full(int(sizes.sum()) + hi - lo + 1, SPACE, np.uint8)
        place = np.ones(len(spaced), bool)
        place[0] = False
        place[begin + sizes] = False
        spaced[place] = letters
        out[lo:hi] = payloads(spaced, begin, begin + sizes, held)
        lo = hi
    return out, first


_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the CRC-32 polynomial, bit-reversed."""
    a, out = a.copy(), np.zeros_like(b)
    for bit in range(31, -1, -1):
        out ^= np.where((b >> np.uint64(bit)) & np.uint64(1), a, np.uint64(0))
        a = (a >> np.uint64(1)) ^ np.where(a & np.uint64(1), np.uint64(_POLY), np.uint64(0))
    return out


def shift_of(lengths: np.ndarray) -> np.ndarray:
    """x^(8 n) modulo the polynomial, for every n."""
    out = np.full(len(lengths), 1 << 31, np.uint64)
    square = np.full(1, 1 << 23, np.uint64)  # x^8
    left = lengths.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _times(out[odd], np.broadcast_to(square, (int(odd.sum()),)))
        square, left = _times(square, square), left >> 1
    return out


def join_crc(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Payloads of ``a``, one blank and ``b``, from the payloads of both."""
    mask = np.uint64(0xFFFFFFFF)
    a, b = a.view(np.uint64), b.view(np.uint64)
    space = np.uint64(zlib.crc32(b" "))
    left = _times(shift_of(np.ones(len(a), np.int64)), a & mask) ^ space
    sizes, back = np.unique(b >> np.uint64(32), return_inverse=True)
    crc = _times(shift_of(sizes)[back], left) ^ (b & mask)
    return (crc | ((a >> np.uint64(32)) + (b >> np.uint64(32)) + np.uint64(1)) << np.uint64(32)).view(np.int64)


def features(col: pa.Array, held: Dictionary, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row and bucket of every run of 1 to ``runs`` words, and the number of words of each row."""
    words, first = word_payloads(col, held)
    row = np.repeat(np.arange(len(col)), np.diff(first))
    rows, found, run = [row], [words], words
    for k in range(1, runs):
        same = row[k:] == row[:-k]
        run = join_crc(run[:-1], words[k:])
        rows.append(row[k:][same])
        found.append(run[same])
    return np.concatenate(rows), (np.concatenate(found) & 0xFFFFFFFF) % buckets, np.diff(first)


def held_words() -> Dictionary:
    return _WORKER.setdefault(WORDS, Dictionary(WORDS))


def bucket_counts(texts: DataFrame, text_col: str, runs: int, buckets: int) -> np.ndarray:
    """How many features of all rows each bucket holds; every task hands in one sum per bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(features(batch.column(0), held_words(), runs, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(tidy(count), "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row per bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's smoothed shares in target and source, rounded down."""
    n = len(source)
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n))))
                     for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """A standard Gumbel variate of the id, times 1000, rounded down."""
    first = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(first, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
          runs: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, n_features, weight and score."""
    spark = docs.sparkSession
    prepare(spark)
    gain = spark.sparkContext.broadcast(gains(  # one number per bucket
        bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_text_col, runs, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, n_words = features(batch.column(1), held_words(), runs, buckets)
            n = np.bincount(row, minlength=len(batch))
            total = np.zeros(len(batch), np.int64)
            np.add.at(total, row, gain.value[bucket])
            yield pa.record_batch([batch.column(0), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                  ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(tidy(run), f"id {kind}, n_words long, n_features long, weight long") \
        .select(F.col("id").alias(id_col), "n_words", "n_features", "weight",
                (F.col("weight") + noise(F.col("id"), seed)).cast("long").alias("score"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             runs: int = 1, buckets: int = BUCKETS, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_features, weight, score, and rank among those drawn, else null.

    Of the rows with at least ``min_words`` words, ``percent`` in a hundred (rounded down) with the
    highest scores are drawn, ties by smaller id. Null texts have no words, weight 0 and are never drawn
    while ``min_words`` is above 0; a null id is scored like an empty one and comes last among ties;
    repeated rows give repeated rows with ranks of their own; very long texts are scanned in pieces; other
    columns are not read; an empty target has no features; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = work_path(spark, "scores")
    weigh(docs, target, id_col, text_col, target_text_col, runs, buckets, seed).write.parquet(path)
    rows = spark.read.parquet(path)
    # Scores are whole numbers between fixed bounds, so counts per score are few, whatever the number of rows.
    per_score = rows.where(F.col("n_words") >= min_words).groupBy(F.col("score").alias("s")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1))
    steps = per_score.select("s", F.coalesce(above, F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy()).alias("all")) \
        .withColumn("drawn", F.floor(F.col("all") * percent / 100)).where("above < drawn")
    # Only drawn scores are ranked, each for itself, behind the rows of higher scores.
    open_ = rows.join(F.broadcast(steps), (F.col("n_words") >= min_words) & (F.col("score") == F.col("s")), "left")
    place = F.row_number().over(Window.partitionBy("s").orderBy(F.col(id_col).asc_nulls_last()))
    ranked = open_.where("s is not null").withColumn("rank", F.col("above") + place) \
        .withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")))
    columns = [id_col, "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(
        open_.where("s is null").withColumn("rank", F.lit(None).cast("long")).select(*columns))
