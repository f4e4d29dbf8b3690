"""The filter audit, the class-based model and importance resampling against their plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from accountloom.llm import class_lm, filter_audit, importance
from tests.llm import brute, cases

FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.rows(), cases.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def plain():
    return [(r[0], r[1]) for r in cases.rows()]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(cases.items(), "item_id long, text string")


def by_id(df, *columns):
    rows = df.select(df.columns[0], *columns).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


# Filter audit

LABELS = [(3 * i, i % 2, int(i % 5 == 0)) for i in range(70)] + [(6, None, 1), (9, 1, None), (9, 0, 0), (None, 1, 1)]


def audit_rows(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIGURES) for r in rows}
    assert len(out) == len(rows)
    return out


def parts_of(rows):
    return [(i, t, (None, "", "de", "fr")[k % 4]) for k, (i, t) in enumerate(rows)]


def test_audit(spark, plain):
    extra = [(900 + i, t) for i, t in enumerate([" ".join(f"w{j % 150}" for j in range(260)), "A B " * 120, " ".join(
        f"u{j}" for j in range(230)), "same words here " * 90, "# $ " * 110, "Zürich ÄÖ " * 70])]
    rows = parts_of([*plain, *extra, *[(2000 + i, t) for i, t in extra]])
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows],
                               "doc_id long, text string, lang string, part string, n long, cell long").repartition(6)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = audit_rows(filter_audit.audit_filters(df, labels))
    want = brute.op11(rows, LABELS)
    assert len(got) == 600 * 3 and got == want
    # Each filter's share of what it removes is the same, however the steps are cut into batches.
    assert audit_rows(filter_audit.audit_filters(df.repartition(1), labels)) == want


def test_audit_repeated_rows_null_ids_and_empty_tables(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(empty, none).count() == 0
    rows = [(2, "a"), (2, "a"), (5, "a"), (None, "a"), (None, None), (7, None), (7, "")]
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    got = audit_rows(filter_audit.audit_filters(df, none))
    # Copies: 5 and the null id of 'a', and the null id of the empty text; 7 stands twice under one id.
    assert got["", "EABCD", 1] == (4, 3, 0, 0, 0, 0, 3 * 24 + 0 * 96 + 3 * 36)
    assert {k[0] for k in got} == {""} and len(got) == 600


def test_audit_meets_one_text_in_few_rows(spark):
    rows = [(i, "the same text", ("de", "fr")[i % 2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    got = audit_rows(filter_audit.audit_filters(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got["de", "EABCD", 1][:2] == (1, 1999) and got["fr", "EABCD", 1][:2] == (0, 2000)


def test_contraction_is_a_sum_over_cells():
    r = np.random.default_rng(3)
    tensor = r.integers(0, 50, (3, 2, 2, 2, 2))
    select = np.array([[(1, 0), (0, 1), (1, 1)], [(1, 1), (1, 1), (1, 1)]])
    out = filter_audit.contract(tensor, select)
    assert out.shape == (3, 2, 2)
    assert (out[..., 0] == tensor[:, :, 0, 1].sum(-1)).all() and (out[..., 1] == tensor.sum((2, 3, 4))).all()


# Class-based model

def trained_on(plain):
    return [x for x in plain if zlib.crc32(str(x[0]).encode()) % 10]


@pytest.mark.parametrize("classes, core, tier", [(64, 1 << 16, 1 << 18), (5, 40, 25), (2, 0, 0)])
def test_class_model_scores(spark, docs, plain, empty, classes, core, tier):
    model = class_lm.train(docs.where(~class_lm.held_out(F.col("doc_id"))), classes=classes, core=core, rounds=3)
    words = {r.word: (r.n, r["class"]) for r in spark.read.parquet(model.words).collect()}
    got = by_id(class_lm.score(docs, model, tier=tier), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = brute.op12(plain, trained_on(plain), {w: c for w, (_, c) in words.items()}, classes)
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert got[i][:3] == x[:3] and got[i][3:] == pytest.approx(x[3:], rel=1e-9)
    # Every word of the training texts has one class, and the end has its own.
    own = [w for _, t in trained_on(plain) for w in [*brute.WORD.findall((t or "").translate(brute.LOWER)), " "]]
    assert {w: n for w, (n, _) in words.items()} == dict(brute.Counter(own)) and len(words) == model.types
    assert [w for w, (_, c) in words.items() if c == 0] == [" "]
    assert class_lm.score(empty, model).count() == 0


def test_class_model_adds_up_to_one(spark, docs):
    model = class_lm.train(docs, classes=6, core=60, rounds=2)
    logs = class_lm.Logs(model)
    words = spark.read.parquet(model.words).toPandas()
    for before in range(7):
        total = sum(10 ** (logs.after[before, c] + logs.words(np.array([n]), np.array([c]))[0]) for n, c in zip(words.n, words["class"]))
        assert total + 10 ** logs.unknown[before] == pytest.approx(1)


def test_class_model_of_nothing_and_of_repeated_rows(spark, docs, empty):
    nothing = class_lm.train(empty)
    got = class_lm.score(docs, nothing).collect()
    assert all(r.n_known == 0 and r.base_score == r.score == 0 for r in got) and len(got) == docs.count()
    rows = spark.createDataFrame([(None, "a b a"), (None, "a b a"), (4, "c"), (4, None)], "doc_id long, text string")
    scored = class_lm.score(rows, class_lm.train(rows, classes=3), tier=1).collect()
    assert sorted((r.doc_id is None, r.n_tokens, r.n_known) for r in scored) == [
        (False, 1, 1), (False, 2, 2), (True, 4, 4), (True, 4, 4)]


def two_tongues(n, seed):
    r = random.Random(seed)
    tongues = [[f"{p}{i}" for i in range(300)] for p in "xy"]
    return [(i, " ".join(r.choice(tongues[i % 2]) for _ in range(60))) for i in range(n)]


def test_exchange_finds_what_stands_together(spark):
    """Two languages that never mix; held-out texts get likelier, and words of one share their classes."""
    rows = two_tongues(300, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for core in (1 << 16, 200):  # in the second, most words are placed after the exchange
        model = class_lm.train(df.where("doc_id >= 40"), classes=5, core=core)
        got = class_lm.score(df.where("doc_id < 40"), model).agg(F.sum("base_score"), F.sum("score")).first()
        assert got[1] > got[0] + 40 * 60 * 0.2
        found = {}
        for r in spark.read.parquet(model.words).where("word != ' '").collect():
            found.setdefault(r["class"], []).append(r.word[0])
        pure = sum(max(x.count("x"), x.count("y")) for x in found.values()) / sum(map(len, found.values()))
        assert pure > 0.95


def test_exchange_raises_the_likelihood(spark, docs):
    pairs = class_lm.count_pairs(docs, "text", pa.array(cases.vocabulary(400, 7)[:150]).unique().cast(pa.string()))
    beside = class_lm.adjacency(spark, pairs)
    n = len(set(cases.vocabulary(400, 7)[:150])) + 1
    fits = [class_lm.likelihood(class_lm.exchange(beside, n, 8, rounds)[1]) for rounds in (0, 2, 6)]
    assert fits[0] < fits[1] <= fits[2]


def test_placements_take_the_best_class():
    """Against the likelihood computed anew for every class."""
    r = np.random.default_rng(5)
    pairs = r.integers(0, 30, (4, 4)).astype(float)
    cell, n = np.array([1, 3, 4 + 2]), np.array([7.0, 2.0, 9.0])
    got = class_lm.placements(np.zeros(3, np.int64), cell, n, 1, None, pairs)[0]
    fits = []
    for k in range(1, 4):
        own = pairs.copy()
        for c, x in zip(cell, n):
            own[(c, k) if c < 4 else (k, c - 4)] += x
        fits.append(class_lm.likelihood(own))
    # A word before and after itself is left out, so the two agree but for shared cells.
    assert got == 1 + int(np.argmax(fits))


def test_frequent_words_are_bounded(spark):
    rows = [(f"w{i}", i + 1) for i in range(500)] + [("x" * 100, 10_000), (" ", 99_999)]
    words = spark.createDataFrame(rows, "word string, n long")
    for most in (0, 1, 50, 499, 500, 10_000):
        got = [r.n for r in class_lm.frequent(words, most).collect()]
        assert len(got) <= most and 10_000 not in got and sorted(got) == list(range(501 - len(got), 501))
    assert class_lm.frequent(words, 50).count() > 30


def test_class_model_beats_counts_on_held_out_texts(spark):
    from accountloom.llm.queries import op12_class_lm

    got = op12_class_lm(spark, "/root/testdata/sf0.01").cache()
    assert got.where(got.held_out != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)).count() == 0
    base, score, tokens = got.where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (score - base) / tokens > 0.3


# Importance resampling

@pytest.mark.parametrize("runs, words", [(1, 1 << 16), (1, 20), (3, 50)])
def test_resampling(docs, plain, items, empty, monkeypatch, runs, words):
    monkeypatch.setattr(importance, "WORDS", words)
    got = by_id(importance.resample(docs, items, runs=runs), "n_features", "weight", "score", "rank")
    assert got == brute.op13(plain, cases.items(), runs)
    assert importance.resample(empty, items).count() == 0


def test_resampling_with_ties_nulls_and_without_target(spark, docs, plain):
    none = spark.createDataFrame([], "item_id long, text string")
    assert by_id(importance.resample(docs, none), "n_features", "weight", "score", "rank") == brute.op13(plain, [])
    text = " ".join(cases.vocabulary(30, 2))
    rows = [(None, text), (8, text), (8, text), (8, text), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resample(df, none, percent=75).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len(got) == 5
    assert [r["rank"] for r in got if r.doc_id == 3] == [None]
    every = importance.resample(df, none, min_words=0, percent=100).collect()
    assert sorted(r["rank"] for r in every) == [1, 2, 3, 4, 5]


def test_runs_of_words_get_the_crc_of_the_joined_text():
    texts = ["Ab cd, EF-gh", "", None, "x" * 200 + " é ñandú x", "one", "a b c d e"]
    held = importance.Dictionary(4)
    for _ in range(2):  # the second time, some words are known
        row, bucket, n_words = importance.features(pa.array(texts), held, 3, 1 << 32)
        got = sorted(zip(row.tolist(), bucket.tolist()))
        want = []
        for i, text in enumerate(texts):
            w = brute.ALNUM.findall((text or "").translate(brute.LOWER))
            want += [(i, zlib.crc32(" ".join(w[a:a + k]).encode())) for k in (1, 2, 3) for a in range(len(w) - k + 1)]
        assert got == sorted(want) and n_words.tolist() == [4, 0, 0, 4, 1, 5]


def test_texts_are_scanned_in_pieces(monkeypatch):
    monkeypatch.setattr(importance, "SCAN", 50)
    text = " ".join(cases.vocabulary(300, 6) + ["z" * 90] + cases.vocabulary(40, 8))
    words, first = importance.word_payloads(pa.array([text, "", "tail"]), importance.Dictionary(30))
    want = brute.ALNUM.findall(text) + ["tail"]
    assert [x & 0xFFFFFFFF for x in words.tolist()] == [zlib.crc32(w.encode()) for w in want]
    assert [x >> 32 for x in words.tolist()] == [len(w.encode()) for w in want] and first.tolist() == [0, len(want) - 1, len(want) - 1, len(want)]
