"""Class-based n-grams: words are clustered by exchange, and texts are scored by classes.

The probability of a word is that of its class after the class before it, times that of the word
in its class. Classes are found by exchange: a word moves to the class in which the likelihood of
the training text is greatest.

Everything is counted over all training documents. One scan counts words. The most frequent ones
(``CORE`` at most) are numbered, and a second scan counts pairs: those of two numbered words are
packed by ranges of words and merged into one adjacency table, which a round of exchange reads with
nothing but the words' classes and the class matrix at hand, both of fixed size. Half of the numbered words may move in a round, so that
words do not swap places for ever. Every other word, whatever its count, is then placed by the same
exchange from its own neighbours, and the table of all words with their classes is written: it
grows with the text and is never broadcast or collected.

Scoring looks words up in a table of the ``TIER`` most frequent; runs of other words are written out
with the classes around them, joined with the whole table, and added to their document's sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.llm.common import LOWER, WHITE, prepare, spans_of, text_buffer, tidy
from accountloom.session import work_path

END = " "
"""What stands for the end of a document among the words; no word holds a blank."""
CLASSES = 64
CORE = 1 << 16
TIER = 1 << 18
LONGEST = 64
"""Longer words are never numbered, so that the numbered ones have a bounded size."""
ROUNDS = 8
SMOOTH = 0.1
FEW = 15
BACK_OFF = 16.0
"""Weight of the classes' own shares among the transitions from a class, in tokens."""


class Model(NamedTuple):
    words: str
    """Path of the table of all training words: word, n, class."""
    tokens: int
    types: int
    pairs: np.ndarray
    """How often each class follows each, over all training documents."""
    size: np.ndarray
    """Tokens of each class."""
    once: np.ndarray
    """Words of each class that occur once."""


class Tokens:
    """The lower-cased words of one Arrow text column, numbered within the batch."""

    def __init__(self, col: pa.Array):
        data, offs = text_buffer(col)
        starts, ends = spans_of(data, offs, WHITE)
        self.first = np.searchsorted(starts, offs)
        letters = LOWER[data[~WHITE[data]]]
        upto = np.concatenate([[0], np.cumsum(ends - starts)])
        flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(upto), pa.py_buffer(letters))
        coded = flat.dictionary_encode()
        self.words = coded.dictionary.cast(pa.string())
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = len(col)

    def closed(self, codes: np.ndarray, end: int) -> np.ndarray:
        """The codes of all rows in a row, with ``end`` before the first and after every row."""
        out = np.full(len(codes) + self.rows + 1, end, np.int64)
        out[1 + np.arange(len(codes)) + np.repeat(np.arange(self.rows), np.diff(self.first))] = codes
        return out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"))


def _write(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "zstd").parquet(path)


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of all documents, ``END`` among them; batches hand in one row per distinct word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Tokens(batch.column(0))
            n = np.bincount(t.codes, minlength=len(t.words))
            yield pa.record_batch([pa.concat_arrays([t.words, pa.array([END])]), pa.array(np.append(n, t.rows))], ["word", "n"])

    return _texts(docs, text_col).mapInArrow(tidy(count), "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words above a count chosen so that they are at most ``most``; none is longer than ``LONGEST``.

    Words are counted by steps of their count's logarithm, so that nothing is sorted: the result is
    the largest set of whole steps that fits.
    """
    step = F.floor(F.log2("n") * 16)
    fit = words.where((F.col("word") != END) & (F.octet_length("word") <= LONGEST))
    per = sorted((r.step, r.k) for r in fit.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect())
    total, least = 0, None
    for s, k in reversed(per):
        total += k
        if total > most:
            break
        least = s
    return fit.where(F.lit(False) if least is None else step >= least)


PAIRS = "kind int, v string, w string, l int, r int, n long, keys binary, counts binary"
RANGES = 1024
"""Ranges of numbered words, each of which is merged and moved as one row."""
MERGE = 1 << 21
"""Entries of a range that are held before they are merged."""


def _pack(values: np.ndarray) -> bytes:
    """64-bit integers, all first bytes first, which compresses well."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _width(n_words: int) -> int:
    """How many numbers a range of words has."""
    return -(-n_words // RANGES)


def count_pairs(docs: DataFrame, text_col: str, core: pa.Array) -> DataFrame:
    """Neighbours over all documents, counted per batch; -1 stands for a word that has no number.

    kind 0: numbered words of the range l, once with the words after them (r = 1) and once with those
    before (r = 0); keys are word x (numbers) + neighbour, in order, as differences. kind 1: another
    word v with the number before it (l) and after it (r). kind 2: two other words v and w.
    """
    shared = docs.sparkSession.sparkContext.broadcast(core)  # at most ``CORE`` short words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = len(shared.value) + 1
        for batch in batches:
            t = Tokens(batch.column(0))
            number = pc.fill_null(pc.index_in(t.words, value_set=shared.value), -2).to_numpy().astype(np.int64) + 1
            # 0 is the end, 1 to base - 1 numbered words, and from base on other words of this batch.
            number = np.where(number < 0, base + np.arange(len(number)), number)
            seq = t.closed(number[t.codes], 0)
            left, right = seq[:-1], seq[1:]
            known_l, known_r = left < base, right < base
            both = known_l & known_r
            keys, n = _counted(left[both] * base + right[both])
            yield _ranges(keys, n, base, 1)
            turned = keys % base * base + keys // base
            order = np.argsort(turned)
            yield _ranges(turned[order], n[order], base, 0)
            at = np.flatnonzero(~known_l[1:]) + 1  # the word itself stands between left[at - 1] and right[at]
            before = np.where(left[at - 1] < base, left[at - 1], -1) + 1
            after = np.where(right[at] < base, right[at], -1) + 1
            keys, n = _counted(((left[at] - base) * (base + 1) + before) * (base + 1) + after)
            word = keys // (base + 1) ** 2
            yield _pairs(1, keys // (base + 1) % (base + 1) - 1, keys % (base + 1) - 1, v=t.words.take(pa.array(word)), n=pa.array(n))
            rest = ~known_l & ~known_r
            own = len(t.words)
            keys, n = _counted((left[rest] - base) * own + right[rest] - base)
            if len(keys):
                hollow = np.full(len(keys), -1)
                yield _pairs(2, hollow, hollow, v=t.words.take(pa.array(keys // own)), w=t.words.take(pa.array(keys % own)),
                             n=pa.array(n))

    return _texts(docs, text_col).mapInArrow(tidy(count), PAIRS)


def _pairs(kind: int, left: np.ndarray, right: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"v": pa.string(), "w": pa.string(), "n": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
    found = {"kind": pa.array(np.full(len(left), kind, np.int32)), "l": pa.array(left.astype(np.int32)),
             "r": pa.array(right.astype(np.int32)), **{c: columns.get(c, pa.nulls(len(left), t)) for c, t in kinds.items()}}
    return pa.record_batch([found[c] for c in ("kind", "v", "w", "l", "r", "n", "keys", "counts")],
                           ["kind", "v", "w", "l", "r", "n", "keys", "counts"])


def _ranges(keys: np.ndarray, n: np.ndarray, base: int, side: int) -> pa.RecordBatch:
    """One row per range of words with its part of the ascending keys."""
    width = _width(base)
    some = np.unique(keys // base // width)
    at = np.append(np.searchsorted(keys, some * width * base), len(keys))
    parts = list(zip(at[:-1].tolist(), at[1:].tolist()))
    return _pairs(0, some, np.full(len(some), side), keys=pa.array([_pack(np.diff(keys[a:b], prepend=0)) for a, b in parts], pa.binary()),
                  counts=pa.array([_pack(n[a:b]) for a, b in parts], pa.binary()))


def _phi(x: np.ndarray) -> np.ndarray:
    """x log x."""
    return x * np.log(np.maximum(x, 1.0))


def placements(word: np.ndarray, cell: np.ndarray, n: np.ndarray, n_words: int, own: np.ndarray | None,
               pairs: np.ndarray) -> np.ndarray:
    """The class of each of ``n_words`` words in which the likelihood is greatest.

    ``cell`` is a side (0 before, 1 after) times the number of classes plus a class, and ``n`` how often
    the word has such a neighbour; ``word`` is ascending. ``own`` is the class that the word is in
    and taken out of; None for words that are in none. All other words are taken to stay where they are.
    Class 0, that of the end, takes no words.
    """
    k = len(pairs)
    out = np.zeros(n_words, np.int64)
    beside = np.concatenate([pairs, pairs.T])  # a row per cell: what each class has of such neighbours
    plain = _phi(beside)
    added = np.stack([_phi(beside + few) - plain for few in range(FEW + 1)])  # most counts are small
    # As left and as right member of a pair: how often the class and the word are met.
    roles = [(pairs.sum(1 - side), np.bincount(word[cell // k == side], n[cell // k == side], n_words)) for side in (0, 1)]
    first = np.searchsorted(word, np.arange(n_words + 1))
    for lo, hi in _chunks(first, 1 << 12):
        a, b = first[lo], first[hi]
        at, more = cell[a:b], n[a:b].astype(float)
        more_likely = added[np.minimum(n[a:b], FEW).astype(np.int64), at]
        many = np.flatnonzero(more > FEW)
        more_likely[many] = _phi(beside[at[many]] + more[many, None]) - plain[at[many]]
        if own is not None:
            mine = own[word[a:b]]
            have = np.maximum(beside[at, mine] - more, 0)
            more_likely[np.arange(b - a), mine] = _phi(have + more) - _phi(have)
        gain = np.zeros((hi - lo, k))
        some = np.flatnonzero(first[lo + 1:hi + 1] > first[lo:hi])
        if len(some):
            gain[some] = np.add.reduceat(more_likely, first[lo + some] - a, axis=0)
        for size, times in roles:
            there, times = np.broadcast_to(size, gain.shape).copy(), times[lo:hi]
            if own is not None:
                there[np.arange(hi - lo), own[lo:hi]] -= times
            there = np.maximum(there, 0)
            gain -= _phi(there + times[:, None]) - _phi(there)
        gain[:, 0] = -np.inf
        best = gain.argmax(1)
        if own is not None:  # stay unless another class is better by more than rounding
            stay = gain[np.arange(hi - lo), own[lo:hi]]
            best = np.where((own[lo:hi] > 0) & (gain.max(1) - stay > 1e-6 * np.abs(stay)), best, own[lo:hi])
        out[lo:hi] = best
    return out


def _chunks(first: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Runs of words with at most ``cells`` cells and words together, or one larger word each."""
    lo, n = 0, len(first) - 1
    weight = first + np.arange(n + 1)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(weight, weight[lo] + cells, side="right")) - 1)
        yield lo, hi
        lo = hi


class _Merged:
    """The entries of one range and side: distinct keys with their counts."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting, self.held = [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((keys, n))
        self.held += len(keys)
        if self.held > MERGE:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            keys = np.concatenate([self.keys, *[k for k, _ in self.waiting]])
            n = np.concatenate([self.n, *[c for _, c in self.waiting]])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.keys, self.n = keys[first], np.add.reduceat(n[order], first)
            self.waiting, self.held = [], 0


ADJACENCY = "after binary, n_after binary, before binary, n_before binary"


def adjacency(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """One row per range of numbered words: all their neighbours on both sides, and how often they are met.

    Written once, and read by every round. A range's parts arrive in order and are merged as they come,
    so a task holds what a range's words can have in different neighbours at most.
    """
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, [_Merged(), _Merged()]

        def emit() -> pa.RecordBatch:
            for side in sides:
                side.merge()
            columns = [x.astype("<i8").tobytes() for side in (sides[1], sides[0]) for x in (side.keys, side.n)]
            return pa.record_batch([pa.array([x], pa.binary()) for x in columns], ["after", "n_after", "before", "n_before"])

        for batch in batches:
            for at, side, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("l", "r", "keys", "counts"))):
                if at != now:
                    if now is not None:
                        yield emit()
                    now, sides = at, [_Merged(), _Merged()]
                sides[side].add(np.cumsum(_unpack(keys)), _unpack(counts))
        if now is not None:
            yield emit()

    path = work_path(spark, "adjacency")
    pairs.where("kind = 0").select("l", "r", "keys", "counts").repartition("l").sortWithinPartitions("l") \
        .mapInArrow(tidy(merge), ADJACENCY).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _ints(batch: pa.RecordBatch, *names: str) -> Iterator[list[np.ndarray]]:
    """The unpacked columns of every row."""
    columns = [batch.column(batch.schema.get_field_index(name)) for name in names]
    for row in zip(*columns):
        yield [np.frombuffer(x.as_buffer(), "<i8") for x in row]


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of every element of a list column."""
    col = batch.column(batch.schema.get_field_index(name))
    row = np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False))
    return row, col.flatten().to_numpy(zero_copy_only=False)


def _matrix(rows: DataFrame, k: int) -> np.ndarray:
    """The class matrix from (cell, n); one row per cell reaches the driver."""
    out = np.zeros(k * k)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out.reshape(k, k)


def class_pairs(beside: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """How often each class follows each among numbered words."""
    shared = beside.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(k * k), shared.value
        for batch in batches:
            for keys, n in _ints(batch, "after", "n_after"):
                total += np.bincount(own[keys // len(own)] * k + own[keys % len(own)], weights=n, minlength=k * k)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some].astype(np.int64))], ["cell", "n"])

    return _matrix(beside.select("after", "n_after").mapInArrow(tidy(count), "cell long, n long"), k)


def likelihood(pairs: np.ndarray) -> float:
    """What the classes contribute to the log-likelihood of the text that ``pairs`` were counted in."""
    return float(_phi(pairs).sum() - _phi(pairs.sum(0)).sum() - _phi(pairs.sum(1)).sum())


def exchange(beside: DataFrame, n_words: int, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the numbered words after ``rounds`` rounds, the best seen, and their class matrix.

    The driver holds one class per numbered word and one number per pair of classes.
    """
    classes = np.zeros(n_words, np.int64)
    classes[1:] = 1 + np.arange(n_words - 1) % max(1, k - 1)
    best = (-np.inf, classes, np.zeros((k, k)))
    for turn in range(rounds + 1):
        pairs = class_pairs(beside, classes, k)
        if (fit := likelihood(pairs)) > best[0]:
            best = (fit, classes, pairs)
        if turn == rounds:
            break
        shared = beside.sparkSession.sparkContext.broadcast((classes, pairs))

        def move(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            own, matrix = shared.value
            for batch in batches:
                for after, n_after, before, n_before in _ints(batch, "after", "n_after", "before", "n_before"):
                    at = np.concatenate([after, before])
                    side = np.repeat([1, 0], [len(after), len(before)])
                    word, row = np.unique(at // n_words, return_inverse=True)
                    profile = np.bincount(row * (2 * k) + side * k + own[at % n_words], np.concatenate([n_after, n_before]),
                                          len(word) * 2 * k)
                    cells = np.flatnonzero(profile)
                    new = placements(cells // (2 * k), cells % (2 * k), profile[cells], len(word), own[word], matrix)
                    keep = (word > 0) & ((word + turn) % 2 == 0) & (new != own[word])
                    yield pa.record_batch([pa.array(word[keep]), pa.array(new[keep])], ["word", "class"])

        moved = beside.mapInArrow(tidy(move), "word long, class long").toArrow()  # numbered words at most
        if not len(moved) and turn:
            break
        classes = classes.copy()
        classes[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    return best[1], best[2]


def place_rest(pairs: DataFrame, classes: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(word, class, cell, n): the class of all words without a number, from their numbered neighbours.

    Rows without a word say how often a pair of classes (``cell``) is met among these neighbours. A word
    has at most one entry per pair of classes; one without numbered neighbours goes to the first class.
    """
    shared, k = pairs.sparkSession.sparkContext.broadcast((classes, matrix)), len(matrix)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value[0]
        for batch in batches:
            near = [batch.column(name).to_numpy() for name in ("l", "r")]
            a, b = (np.where(x < 0, -1, own[x] + side * k) for side, x in enumerate(near))
            yield pa.record_batch([batch.column("v"), pa.array(a), pa.array(b), batch.column("n")], ["word", "a", "b", "n"])

    cells = pairs.where("kind = 1").select("v", "l", "r", "n").mapInArrow(tidy(fold), "word string, a long, b long, n long") \
        .repartition("word").groupBy("word", "a", "b").agg(F.sum("n").alias("n")).groupBy("word").agg(
            F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.collect_list("n").alias("n"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for batch in batches:
            row, a = _flat(batch, "a")
            b, n = _flat(batch, "b")[1], _flat(batch, "n")[1]
            key = np.concatenate([row * (2 * k) + a, row * (2 * k) + b])
            known = np.concatenate([a, b]) >= 0
            cells, back = np.unique(key[known], return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([n, n])[known], minlength=len(cells))
            word, cell = cells // (2 * k), cells % (2 * k)
            new = placements(word, cell, n, len(batch), None, shared.value[1])
            total += np.bincount(np.where(cell < k, cell * k + new[word], new[word] * k + cell - k), n, k * k)
            nothing = pa.nulls(len(batch), pa.int64())
            yield pa.record_batch([batch.column("word"), pa.array(new), nothing, nothing], ["word", "class", "cell", "n"])
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.nulls(len(some), pa.string()), pa.nulls(len(some), pa.int64()), pa.array(some),
                               pa.array(total[some].astype(np.int64))], ["word", "class", "cell", "n"])

    return cells.mapInArrow(tidy(place), "word string, class long, cell long, n long")


def train(docs: DataFrame, text_col: str = "text", classes: int = CLASSES, core: int = CORE, rounds: int = ROUNDS) -> Model:
    """A model of all rows of ``docs``: every word gets one of ``classes`` classes, at least 2.

    A null text is an empty document (its end alone); repeated rows count as often as they stand; other
    columns are not read; words and texts of any length count. A word that fits two classes equally goes
    to the one of smaller number. No documents give a model without words.
    """
    spark = docs.sparkSession
    prepare(spark)
    counted, found, placed, path = (work_path(spark, name) for name in ("words", "pairs", "placed", "classes"))
    _write(count_words(docs, text_col), counted)
    words = spark.read.parquet(counted)
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not tokens:
        words.withColumn("class", F.lit(0).cast("long")).write.parquet(path)
        return Model(path, 0, 0, np.zeros((classes, classes)), np.zeros(classes), np.zeros(classes))
    # ``core`` rows at most; numbers by hash, so that ranges of them hold frequent and rare words alike.
    top = frequent(words, core).orderBy(F.xxhash64("word"), "word").select("word").toArrow()
    top = pa.concat_arrays([pa.array([], pa.string()), *top.column(0).chunks])
    _write(count_pairs(docs, text_col, top), found)
    pairs = spark.read.parquet(found)
    own, matrix = exchange(adjacency(spark, pairs), len(top) + 1, classes, rounds)
    _write(place_rest(pairs, own, matrix), placed)
    rest = spark.read.parquet(placed)
    numbered = spark.createDataFrame(pa.table([pa.concat_arrays([pa.array([END]), top]), pa.array(own)], ["word", "class"]))
    words.join(numbered.unionByName(rest.where("word is not null").select("word", "class")), "word") \
        .select("word", "n", "class").write.parquet(path)
    held = spark.read.parquet(path)
    known = held.select("word", "class")
    others = pairs.where("kind = 2").select("v", "w", "n") \
        .join(known.toDF("v", "cv"), "v").join(known.toDF("w", "cw"), "w") \
        .select((F.col("cv") * classes + F.col("cw")).alias("cell"), "n")
    matrix = matrix + _matrix(rest.where("word is null").select("cell", "n").unionByName(others), classes)
    size, once = np.zeros(classes), np.zeros(classes)
    for r in held.groupBy("class").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect():
        size[r["class"]], once[r["class"]] = r.n, r.once
    return Model(path, int(tokens), int(types), matrix, size, once)


class Logs:
    """Base-10 logarithms of a model's probabilities.

    A class follows another as often as seen, backed off to the classes' own shares. Of each class, as
    many tokens as it has words seen once are set aside for unknown words, which belong to no class: the
    word after one sees the classes' shares alone. Over all known words and one unknown word the
    probabilities add up to 1.
    """

    def __init__(self, model: Model):
        k = len(model.size)
        shares = (model.size + SMOOTH) / (model.tokens + SMOOTH * k)
        after = (model.pairs + BACK_OFF * shares) / (model.size[:, None] + BACK_OFF)
        after = np.vstack([after, shares])
        whole = model.size + model.once + SMOOTH
        self.none = k
        self.after = np.log10(after)
        self.whole = np.log10(whole)
        self.unknown = np.log10(after @ ((model.once + SMOOTH) / whole))
        self.floor = float(np.log10(model.tokens + SMOOTH * (model.types + 1)))

    def words(self, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Of words in their classes; 0 where the class is unknown (-1)."""
        return np.where(classes < 0, 0.0, np.log10(np.maximum(n, 1)) - self.whole[np.maximum(classes, 0)])

    def base(self, n: np.ndarray) -> np.ndarray:
        """Of words by their counts alone."""
        return np.log10(n + SMOOTH) - self.floor


SCORED = "n_tokens long, n_known long, base double, score double, " \
         "gaps array<struct<l:int,r:int,words:array<string>>>"


def _scan(docs: DataFrame, shared, kind: str) -> DataFrame:
    """Per row the sums over known words, and the runs of others with the classes around them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier, tier_n, tier_class, ends, logs = shared.value
        for batch in batches:
            t = Tokens(batch.column(1))
            at = pc.fill_null(pc.index_in(t.words, value_set=tier), -1).to_numpy()
            there = at >= 0
            n, own = np.zeros(len(at), np.int64), np.full(len(at), -1)
            n[there], own[there] = tier_n[at[there]], tier_class[at[there]]
            codes = t.closed(t.codes, len(at))
            n, own = np.append(n, ends)[codes], np.append(own, 0)[codes]
            known = own >= 0
            value = logs.words(n, own)
            value[1:] += np.where(known[1:] & known[:-1], logs.after[np.maximum(own[:-1], 0), np.maximum(own[1:], 0)], 0)
            plain = np.where(known, logs.base(n), 0)
            row = np.repeat(np.arange(t.rows), np.diff(t.first) + 1)
            sums = [np.bincount(row, x[1:], t.rows) for x in (plain, value)]
            begin = np.flatnonzero(~known[1:] & known[:-1]) + 1
            end = np.flatnonzero(known[1:] & ~known[:-1]) + 1
            words = t.words.take(pa.array(codes[~known]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)), words)
            gaps = pa.StructArray.from_arrays([pa.array(own[begin - 1].astype(np.int32)), pa.array(own[end].astype(np.int32)), lists],
                                              ["l", "r", "words"])
            per_row = np.concatenate([[0], np.cumsum(np.bincount(row[begin - 1], minlength=t.rows))])
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(t.first) + 1), pa.array(np.bincount(row, known[1:], t.rows).astype(np.int64)),
                 *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), gaps)],
                ["id", "n_tokens", "n_known", "base", "score", "gaps"])

    return docs.mapInArrow(tidy(run), f"id {kind}, {SCORED}")


def _resolve(rows: DataFrame, shared) -> DataFrame:
    """(row, n_known, base, score): what the runs of a row add, with their words' counts and classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value[-1]
        for batch in batches:
            found = batch.column(1)
            row = np.repeat(np.arange(len(batch)), found.value_lengths().to_numpy(zero_copy_only=False))
            flat = found.flatten()
            g, p, left, right, n, own = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("g", "p", "l", "r", "n", "class"))
            order = np.lexsort((p, g, row))
            row, p, left, right, n, own = (x[order] for x in (row, p, left, right, n, own))
            context = np.where(own < 0, logs.none, own)
            before = np.where(p == 0, left, np.append(0, context[:-1]))
            known = own >= 0
            value = np.where(known, logs.words(n, own) + logs.after[before, np.maximum(own, 0)], logs.unknown[before])
            last = np.append(p[1:] == 0, np.ones(min(1, len(p)), bool))  # the known word after it sees its class
            value += np.where(last, logs.after[context, right], 0)
            sums = [np.bincount(row, x, len(batch)) for x in (logs.base(n), value)]
            yield pa.record_batch([batch.column(0), pa.array(np.bincount(row, known, len(batch)).astype(np.int64)), *map(pa.array, sums)],
                                  ["row", "more_known", "more_base", "more_score"])

    return rows.mapInArrow(tidy(run), "row long, more_known long, more_base double, more_score double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", tier: int = TIER) -> DataFrame:
    """Per row: ``id_col``, n_tokens (words and the end), n_known, train_tokens, base_score, score.

    Both scores are log10 probabilities of the whole text, the first by counts of words alone. A
    null text is empty: its end alone; a null id is kept; repeated rows give repeated rows; other columns
    are not read; very long texts are one row like any other; an empty table gives an empty result. With
    a model of no words every text is certain: both scores are 0.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    words = spark.read.parquet(model.words)
    common = frequent(words, tier).toArrow()  # ``tier`` rows at most
    ends = words.where(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
    shared = spark.sparkContext.broadcast((
        pa.concat_arrays([pa.array([], pa.string()), *common.column("word").chunks]), common.column("n").to_numpy(),
        common.column("class").to_numpy(), ends, Logs(model)))
    path = work_path(spark, "scored")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    _scan(rows, shared, kind).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    scored = spark.read.parquet(path)
    # Words outside the broadcast table meet the whole table; their runs come back to their row.
    gaps = scored.select("row", F.posexplode("gaps").alias("g", "gap")) \
        .select("row", "g", "gap.l", "gap.r", F.posexplode("gap.words").alias("p", "word"))
    met = gaps.join(words, "word", "left").select("row", F.struct(
        "g", "p", "l", "r", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.lit(-1)).alias("class")).alias("one"))
    more = _resolve(met.groupBy("row").agg(F.collect_list("one").alias("found")), shared)
    certain = model.tokens == 0
    return scored.drop("gaps").join(more, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens",
        (F.lit(0) if certain else F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.lit(0) if certain else F.col("base") + F.coalesce("more_base", F.lit(0))).cast("double").alias("base_score"),
        (F.lit(0) if certain else F.col("score") + F.coalesce("more_score", F.lit(0))).cast("double").alias("score"))


def held_out(id_col: Column) -> Column:
    """Whether the crc32 of the id as text is a multiple of ten; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 == 0, F.lit(False))
