"""Toxicity by compression distance, with one zstandard dictionary per kind of text.

A text is cut into windows of words. Each is compressed with a dictionary of ordinary text and with
one that holds toxic passages before the same ordinary text. Since the second differs from the
first by the toxic passages alone, a window compresses better with it only where it resembles
them. The savings of a text's windows (mean, shares above thresholds, the largest) are turned into
a probability by a logistic function calibrated on labelled texts that the dictionaries have not
seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom.llm.common import give_back, prepare, tidy

WINDOW = 8
LEVEL = 5
SAMPLE = 1200
"""Most toxic texts that the model is fitted on, the first by hash of the id, with at most four
times as many ordinary ones. This bounds the fit, which runs on the driver."""
ORDINARY = 4
SAMPLE_CHARS = 1 << 14
"""Longer labelled texts are not used for fitting."""
PLAIN_BYTES = 8192
PLAIN_WINDOWS = 100_000
"""Most windows that the ordinary dictionary is trained on, every n-th of all those of the sample."""
TOXIC = ((512, 512), (1024, 1024), (1024, 2048))
"""Choices for the toxic dictionary: its size, and the bytes of the words, those that tell most, whose
passages it is trained on. The choice with the least loss out of fold is taken."""
GRAM = 6
FOLDS = 3
SAVINGS = (2, 4)


class Model(NamedTuple):
    plain: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    """The intercept, then a weight for every feature."""


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def windows_of(text: str) -> list[bytes]:
    words = words_of(text)
    return [b" " + b" ".join(words[a:a + WINDOW]) for a in range(0, len(words), WINDOW)]


def _grams(word: bytes) -> list[bytes]:
    """The pieces of a word with its blanks; a shorter word is one piece."""
    word = b" " + word + b" "
    return [word[i:i + GRAM] for i in range(max(1, len(word) - GRAM + 1))]


def telling_words(texts: list[str], labels: np.ndarray) -> list[bytes]:
    """Words of toxic texts by how much more of these than of ordinary ones hold a piece of theirs.

    The order is by the z score of the difference of the two shares, that of the word's best piece.
    Only words without any piece that is more frequent in toxic texts are left out.
    """
    held = (Counter(), Counter())
    words: set[bytes] = set()
    for text, label in zip(texts, labels.tolist()):
        own = set(words_of(text))
        held[label].update({g for w in own for g in _grams(w)})
        if label:
            words |= own
    n0, n1 = int((labels == 0).sum()), int((labels == 1).sum())
    z = {}
    for gram, toxic in held[1].items():
        share = (toxic + held[0][gram]) / (n0 + n1)
        z[gram] = 0.0 if share == 1 else (toxic / n1 - held[0][gram] / max(n0, 1)) \
            / (share * (1 - share) * (1 / n1 + 1 / max(n0, 1))) ** 0.5
    best = {w: max(z[g] for g in _grams(w)) for w in words}
    return sorted((w for w in words if best[w] > 0), key=lambda w: (-best[w], w))


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the joined samples where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(texts: list[str], labels: np.ndarray, choices: tuple[tuple[int, int], ...] = TOXIC) -> list[bytes]:
    """The ordinary dictionary, and a toxic one of every choice: passages that tell, then the ordinary one."""
    ordinary = [w for t, y in zip(texts, labels) if not y for w in windows_of(t)]
    plain = _trained(ordinary[::max(1, -(-len(ordinary) // PLAIN_WINDOWS))], PLAIN_BYTES)
    plain = plain or b"\0" * 8
    ranked = telling_words(texts, labels)
    upto = np.cumsum([len(w) + 1 for w in ranked])
    words = [w for t, y in zip(texts, labels) if y for w in words_of(t)]
    out = [plain]
    for size, ranked_bytes in choices:
        telling = set(ranked[:int(np.searchsorted(upto, ranked_bytes)) + 1])
        passages = [b" " + w for w in words if w in telling]
        out.append(_trained([b"".join(passages[i:i + GRAM]) for i in range(0, len(passages), GRAM)], size) + plain)
    return out


def compressors(*contents: bytes):
    import zstandard

    out = []
    for content in contents:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False,
                                            write_dict_id=False).compress)
    return out


def features(text: str, pair) -> list[float]:
    """Savings of all windows of the whole text; zeros for a text without words."""
    return features_by_choice(text, pair)[0]


def features_by_choice(text: str, held) -> list[list[float]]:
    """The features with every toxic dictionary; ``held`` are compressors, that of ordinary text first."""
    windows = windows_of(text)
    if not windows:
        return [[0.0] * (4 + len(SAVINGS))] * (len(held) - 1)
    plain, *toxic = (np.fromiter(map(len, map(c, windows)), np.int64, len(windows)) for c in held)
    out = []
    for saved in (plain - t for t in toxic):
        top = np.sort(saved)[-3:]
        out.append([float(saved.mean()), *[float((saved >= s).mean()) for s in SAVINGS], float(top.mean()),
                    float(top[-1]), float(np.log1p(len(windows)))])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic function by Newton's method, lightly shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Dictionaries from all texts; their choice and the calibration from texts that their fold's had not seen."""
    fold = np.arange(len(texts)) % FOLDS
    x = np.zeros((len(TOXIC), max(1, len(texts)), 4 + len(SAVINGS)))
    for f in range(FOLDS):
        held = compressors(*dictionaries([t for t, g in zip(texts, fold) if g != f], labels[fold != f]))
        for i in np.flatnonzero(fold == f).tolist():
            x[:, i] = features_by_choice(texts[i], held)
    y = labels.astype(float) if len(texts) else np.zeros(1)
    fits = []
    for choice, own in zip(TOXIC, x):
        center, scale = own.mean(0), own.std(0) + 1e-9
        weights = _logistic((own - center) / scale, y)
        odds = weights[0] + (own - center) / scale @ weights[1:]
        fits.append((float(np.mean(np.logaddexp(0, odds) - y * odds)), choice, center, scale, weights))
    _, choice, center, scale, weights = min(fits, key=lambda x: x[:2])
    return Model(*dictionaries(texts, labels, (choice,)), center, scale, weights)


def score(text: str, model: Model, pair) -> float:
    z = model.weights[0] + float(((np.array(features(text, pair)) - model.center) / model.scale) @ model.weights[1:])
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def held_out(id_col: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 on division by 4; such labels are never learned."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` toxic and ``ORDINARY`` times as many ordinary texts.

    The share of toxic labels among all that may be learned corrects the intercept. Labels other than 0 and 1, ids without a text and held-out ids are left out. Without labels
    the model scores every text alike.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")) \
        .where(F.col("label").isin(0, 1) & ~held_out(F.col("id"))).dropDuplicates(["id"]) \
        .withColumn("turn", F.xxhash64("id"))
    first = [ids.where(F.col("label") == y).orderBy("turn", "id").limit(n)
             for y, n in ((0, sample * ORDINARY), (1, sample))]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # bounded by ``sample``
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .where(F.length("text") <= SAMPLE_CHARS).join(chosen, "id").dropDuplicates(["id"]) \
        .select("turn", "id", "label", "text").toArrow().sort_by([("turn", "ascending"), ("id", "ascending")])
    learned = rows.column("label").to_numpy().astype(np.int64)
    model = fit(rows.column("text").to_pylist(), learned)
    there = {r.label: r.n for r in ids.groupBy("label").agg(F.count("*").alias("n")).collect()}
    have = np.bincount(learned, minlength=2)
    del rows
    give_back()
    if len(there) == 2 and have.all():
        model.weights[0] += np.log(there[1] / there[0]) - np.log(have[1] / have[0])
    return model


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.3) -> DataFrame:
    """Per document: ``id_col``, held_out, score (0 to 1), predicted (1 if score >= ``threshold``).

    A null or empty text scores like one without any saving; a null id is not held out; repeated
    rows give repeated rows; other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(shared.value.plain, shared.value.toxic)
        for batch in batches:
            scores = [score(t.as_py() or "", shared.value, pair) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, score double") \
        .select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(shared.value.plain, shared.value.toxic)
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py() or "", shared.value, pair) < threshold for t in batch.column(at)],
                                        pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
