"""Every operator against its plain version, over a table of awkward cases and an empty one."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from accountloom.llm import (
    decontaminate, jaccard_join, mixing, phrase_dedup, quality_rules, suffix_dedup, token_counts, token_orc, toxicity,
    warc)
from accountloom.llm.components import components
from accountloom.session import work_path
from tests.llm import brute, cases

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SMALL = 4096


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


def test_token_counts(docs, plain, empty):
    got = by_id(token_counts.count_tokens(docs, BYTES), "n_bytes", "n_tokens", "over_limit")
    assert got == brute.op1(plain, BYTES)
    # The table's size changes nothing but speed.
    few = by_id(token_counts.count_tokens(docs, BYTES, frequent=3), "n_bytes", "n_tokens", "over_limit")
    assert few == got
    assert token_counts.count_tokens(empty, BYTES).count() == 0


def test_mixing_meets_targets(docs, empty):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute.op2_targets(sizes)
    assert all(abs(want[s] - target[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = by_id(mixing.mix(docs.repartition(3)), "size", "source_size", "target", "taken")
    assert again == by_id(mixing.mix(docs), "size", "source_size", "target", "taken")
    assert mixing.mix(empty).count() == 0


def test_mixing_takes_whole_epochs_before_the_rest(spark):
    rows = [(i, "w " * (i % 7 + 1), "s") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, (1,), 1.5, 2.0).collect()
    assert all(r["size"] <= r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) == round(1.5 * sum(r["size"] for r in got))
    copies = mixing.mixed_documents(df, (1,), 1.5, 2.0).groupBy("doc_id").count().collect()
    assert {r["count"] for r in copies} == {1, 2} and len(copies) == 500


def test_mixed_documents_keep_columns(docs, empty):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("block_windows", [1 << 17, 5])
def test_decontamination(docs, plain, items, empty, block_windows):
    found = decontaminate.hits(docs, items, block_windows=block_windows).collect()
    got = {r.doc_id: (r.n_words, sum(h.end - h.start for h in r.hits), len(r["items"]),
                      brute.sha(",".join(r["items"]).encode()), bool(r.hits)) for r in found}
    want = brute.op3(plain, cases.items())
    assert len(found) == len(plain) and got == want
    clean = decontaminate.without_hits(docs, items, block_windows=block_windows)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[-1]}
    assert decontaminate.hits(empty, items).count() == 0


def test_decontamination_without_items_and_with_repeats(docs, items, plain):
    none = decontaminate.hits(docs, items.where("item_id = 4")).collect()
    assert len(none) == len(plain) and not any(r.hits for r in none)
    twice = decontaminate.hits(docs.unionAll(docs), items, block_windows=5)
    assert twice.count() == 2 * len(plain)


def test_phrases(docs, plain, empty):
    got = by_id(phrase_dedup.remove_repeats(docs, bucket_bytes=SMALL), "n_words", "n_removed", "kept_sha256")
    assert got == brute.op4(plain)
    assert phrase_dedup.remove_repeats(empty).count() == 0


def test_suffixes(docs, plain, empty):
    got = by_id(suffix_dedup.remove_repeats(docs, bucket_bytes=SMALL).withColumn("n_spans", F.size("spans")),
                "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.op10(plain)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("module", [phrase_dedup, suffix_dedup])
def test_repeated_rows_and_null_ids(spark, docs, module):
    once = {r[0]: r.n_removed for r in module.remove_repeats(docs, bucket_bytes=SMALL).collect()}
    twice = module.remove_repeats(docs.unionAll(docs), bucket_bytes=SMALL).collect()
    assert len(twice) == 2 * len(once) and all(r.n_removed == once[r[0]] for r in twice)
    text = " ".join(cases.vocabulary(60, 3))
    rows = module.remove_repeats(spark.createDataFrame([(None, text), (4, text)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed > 0 for r in rows} == {None: True, 4: False}


def test_random_bytes_against_brute_force(spark):
    import random

    r = random.Random(3)
    pool = ["".join(r.choice("ab ") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 6)):
            p = r.choice(pool)
            a = r.randint(0, 300)
            parts.append(p[a:a + r.randint(20, 99)])
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(suffix_dedup.remove_repeats(df, bucket_bytes=1024).withColumn("n_spans", F.size("spans")),
                "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.op10(rows)
    got = by_id(phrase_dedup.remove_repeats(df, bucket_bytes=1024), "n_words", "n_removed", "kept_sha256")
    assert got == brute.op4(rows)


@pytest.mark.parametrize("copies", [6, 20])
def test_many_copies_in_one_document_and_the_first_in_another_batch(spark, copies):
    words = cases.vocabulary(300, 11)
    passage = " ".join(words[:40])
    rows = [(1, f"{' '.join(words[40:80])} {passage} {' '.join(words[80:120])}"),
            (2, " ".join(f"{passage} {' '.join(words[120 + 9 * i:129 + 9 * i])}" for i in range(copies)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = by_id(suffix_dedup.remove_repeats(df).withColumn("n_spans", F.size("spans")),
                    "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.op10(rows)
        assert by_id(phrase_dedup.remove_repeats(df), "n_words", "n_removed", "kept_sha256") == brute.op4(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_shard_holds_all_stretches_of_a_hot_anchor(spark):
    import random

    from accountloom.llm.repeats import earlier_windows

    r = random.Random(8)
    passage = [r.choice(cases.vocabulary(200, 12)) for _ in range(50)]

    def own() -> list[str]:
        return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30)]

    rows = [(i, " ".join(own() + passage + own())) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for units, solve in ((suffix_dedup.UNITS, suffix_dedup.sort_blocks), (phrase_dedup.UNITS, phrase_dedup.locate)):
        def bounded(s, u, solve=solve):
            assert len(s.lengths) < 200
            return solve(s, u)

        assert earlier_windows(df, "doc_id", "text", units, bounded, SMALL).where("size(gone) > 0").count() == 399
    got = by_id(suffix_dedup.remove_repeats(df, bucket_bytes=SMALL).withColumn("n_spans", F.size("spans")),
                "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.op10(rows)
    got = by_id(phrase_dedup.remove_repeats(df, bucket_bytes=SMALL), "n_words", "n_removed", "kept_sha256")
    assert got == brute.op4(rows)


@pytest.mark.parametrize("variants, hot", [(1, 1), (64, 1), (2, 4096)])
def test_hot_anchors_change_nothing(docs, plain, monkeypatch, variants, hot):
    from accountloom.llm import repeats

    monkeypatch.setattr(repeats, "VARIANTS", variants)
    monkeypatch.setattr(repeats, "HOT", hot)
    got = by_id(suffix_dedup.remove_repeats(docs, bucket_bytes=SMALL).withColumn("n_spans", F.size("spans")),
                "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.op10(plain)
    got = by_id(phrase_dedup.remove_repeats(docs, bucket_bytes=SMALL), "n_words", "n_removed", "kept_sha256")
    assert got == brute.op4(plain)


@pytest.mark.parametrize("tile_bytes", [jaccard_join.TILE_BYTES, 1500])
def test_jaccard(docs, plain, empty, tile_bytes):
    got = by_id(jaccard_join.similar_classes(docs, bucket_bytes=SMALL, tile_bytes=tile_bytes), "n_shingles", "component_id")
    want = brute.op5(plain)
    assert got == want
    if tile_bytes > 1500:
        kept = jaccard_join.first_of_each_class(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in want.items() if x[1] == i)
        assert jaccard_join.similar_classes(empty).count() == 0


def test_jaccard_near_copies_in_a_large_tile(spark):
    import random

    r, words = random.Random(5), cases.vocabulary(500, 5)
    base = [r.choice(words) for _ in range(80)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randrange(80)] = r.choice(words)
        rows.append((i, " ".join(own[: r.choice((80, 70, 60))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.op5(rows)
    for tile in (1 << 23, 3000):
        assert by_id(jaccard_join.similar_classes(df, bucket_bytes=2048, tile_bytes=tile), "n_shingles", "component_id") == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}


@pytest.mark.parametrize("chunk", [3, 50, 1 << 20])
def test_components_in_chunks(spark, monkeypatch, chunk):
    """A random graph with a path, a star and a clique, joined within tasks by chunks of any size."""
    import random

    from accountloom.llm import components as module

    monkeypatch.setattr(module, "CHUNK", chunk)
    r = random.Random(chunk)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(80)]
    edges += [(3000 + i, 3000 + j) for i in range(12) for j in range(12)]
    r.shuffle(edges)
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [] if node in want else [node]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = node
                todo += near[x]
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(rows) == len(want) and {x.node: x.component for x in rows} == want


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_quality(docs, plain, empty):
    rows = quality_rules.judge(docs)
    got = by_id(rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == brute.op6(plain)
    assert all(not (r.base_failed and r.kept) for r in rows.collect())
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "hashpartitioning" not in text
    assert quality_rules.judge(empty).count() == 0


def test_segment_of_very_many_tokens(monkeypatch):
    """Segments of 2^24 ids and more keep their length, beside others, whether they are cached or not."""
    import numpy as np
    import pyarrow as pa

    from accountloom.llm import segments

    long = (1 << 24) + 5
    found = {"aa": np.array([7, 8]), "big": np.arange(long, dtype=np.int32), "c": np.array([9])}
    monkeypatch.setattr(segments, "encode", lambda path, texts: [found[t] for t in texts])
    for pool in (1 << 25, 1 << 10):
        cache = segments.Cache("none", bits=6, pool=pool)
        for _ in range(2):
            ids, start, length = cache.ids(segments.Segmented(pa.array(["aa big c", None, "c aa"]), segments.bare))
            assert length.tolist() == [2, long, 1, 1, 2]
            for at, n, text in zip(start.tolist(), length.tolist(), ("aa", "big", "c", "c", "aa")):
                assert np.array_equal(ids[at:at + n], found[text])


def test_token_files(spark, docs, plain, empty):
    path = work_path(spark, "tokens")
    token_orc.write_tokens(docs, path, WORDS, file_bytes=8192)
    tokens = token_orc.read_tokens(spark, path)
    assert by_id(token_orc.token_index(tokens), "start", "n_tokens", "ids_crc32") == brute.op7(plain, WORDS)
    found = tokens.where("doc_id = 30").select("ids")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,30)]" in found._jdf.queryExecution().executedPlan().toString()
    assert len(found.collect()) == 1
    path = work_path(spark, "tokens")
    token_orc.write_tokens(empty, path, WORDS)
    assert token_orc.token_index(spark.read.schema(tokens.schema).orc(path)).count() == 0


def test_token_files_with_null_and_repeated_ids(spark):
    rows = [(None, "b"), (2, "a b"), (2, "a b"), (1, None)]
    path = work_path(spark, "tokens")
    token_orc.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, WORDS)
    got = sorted(token_orc.token_index(token_orc.read_tokens(spark, path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 2] and [r.start for r in got] == [0, 2, 3, 6]


PAGES = [(5, "u5", "<p>a</p>"), (2, "u2\r\nx", "<p>a</p>"), (9, None, "<p>a</p>"), (7, "u7", None), (1, "u1", ""),
         (3, "u3", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (8, "u8", "é" * 5000)]


@pytest.mark.parametrize("least", [0, 4])
def test_archives(spark, least):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in PAGES],
                                  "page_id long, url string, html string, id string, digest string")
    path = work_path(spark, "archives")
    warc.write_warc(pages, path, min_bytes=least, archive_bytes=2000)
    rows = warc.read_warc(spark, path).collect()
    got = {int(r.page_id): (r.payload_bytes, r.digest, r.record_type, r.refers_to and int(r.refers_to)) for r in rows}
    assert len(rows) == len(PAGES) and got == brute.op8([(r[0], r[2]) for r in PAGES], least)
    text = {r[0]: (r[2] or "").encode() for r in PAGES}
    assert all(bytes(r.payload) == (text[int(r.page_id)] if r.record_type == "response" else b"") for r in rows)


def test_archives_of_no_and_repeated_pages(spark):
    pages = spark.createDataFrame(PAGES[:2] * 2 + [(None, None, "x")], "page_id long, url string, html string")
    path = work_path(spark, "archives")
    warc.write_warc(pages, path)
    rows = warc.read_warc(spark, path).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [
        ("", "response"), ("2", "response"), ("2", "response"), ("5", "revisit"), ("5", "revisit")]
    path = work_path(spark, "archives")
    warc.write_warc(pages.where("page_id = 77"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_archive_query_takes_a_null_id(spark, tmp_path):
    from accountloom.llm.queries import op8_warc

    pages = [(None, "u", "x"), (4, "u", "y"), (6, "u", "y"), (None, "u", "z")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = op8_warc(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [
        (0, "response", 0), (0, "response", 0), (4, "response", 0), (6, "revisit", 4)]


def test_toxicity_held_out(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    from accountloom.llm.queries import op9_toxicity

    got = op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    toxic = [r.score for r in got if r.held_out and r.toxic]
    other = [r.score for r in got if r.held_out and not r.toxic]
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in other) / (len(toxic) * len(other))
    assert above > 0.88
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    blank = toxicity.classify(docs, model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in blank)
    assert toxicity.classify(empty, model).count() == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_toxicity_learns_a_short_cue():
    import random

    import numpy as np

    r, words = random.Random(9), cases.vocabulary(400, 9)

    def text(toxic: bool) -> str:
        own = [r.choice(words) for _ in range(60)]
        if toxic:
            for _ in range(3):
                own[r.randrange(60)] = "vex"
        return " ".join(own)

    labels = np.array([int(i % 5 == 0) for i in range(1500)])
    model = toxicity.fit([text(bool(y)) for y in labels], labels)
    pair = toxicity.compressors(model.plain, model.toxic)
    toxic, other = ([toxicity.score(text(y), model, pair) for _ in range(120)] for y in (True, False))
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in other) / (len(toxic) * len(other))
    assert above > 0.9


def test_toxicity_draws_ordinary_windows_from_all_texts(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "PLAIN_WINDOWS", 10, raising=False)
    seen = []
    monkeypatch.setattr(toxicity, "_trained", lambda samples, size: seen.append(samples) or b"x" * 8)
    words = "%d one two three four five six seven"
    # The first text alone has more windows than the old bound of 100000.
    texts = [" ".join([words % 1] * 100_001), " ".join([words % 2] * 100_001), words % 3]
    toxicity.dictionaries(texts, np.array([0, 0, 1]))
    assert len(seen[0]) <= 10 and {w.split()[0] for w in seen[0]} == {b"1", b"2"}
