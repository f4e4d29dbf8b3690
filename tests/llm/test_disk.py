"""What the similarity join leaves on disk, and what it sends to its tiles."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from accountloom.llm import jaccard_join
from accountloom.llm.components import components
from accountloom.session import work_path
from tests.llm import brute


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for i in range(found.size()) if (x := found.apply(i).getName()).startswith("shuffle_")}


def chain(n, passage, seed=3):
    """Texts of 200 words of their own and, in common with the text before and the one after, a passage."""
    r = random.Random(seed)
    shared = [[f"p{i}x{k}" for k in range(passage)] for i in range(n + 1)]
    out = []
    for i in range(n):
        own = [f"w{i}x{k}" for k in range(200 + r.randrange(20))]
        out.append(own[:90] + shared[i] + own[90:] + shared[i + 1])
    return out


@pytest.fixture(scope="module")
def rows():
    found = chain(80, 24)
    near = [list(found[k]) for k in (5, 40, 41)]
    for k, words in enumerate(near):
        words[60] = f"other{k}"
    return [(i, " ".join(x)) for i, x in enumerate(found + near)]


def test_a_common_passage_ties_no_documents(spark, rows):
    """Only pairs whose prefixes share as much as those of similar texts go to the tiles."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = jaccard_join.with_node(df, "doc_id", "text").select("node", "text")
    classes = spark.sparkContext.broadcast(jaccard_join.frequent_shingles(nodes, 5, 3, 1 << 10, 3))
    tied = components(jaccard_join.candidate_edges(nodes, classes, 5, 75, 3)).groupBy("component").count().collect()
    assert sorted(x["count"] for x in tied) == [2, 2, 2]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_classes(df, bucket_bytes=8192).collect()}
    assert got == brute.op5(rows) and got[80][1] == 5


@pytest.mark.parametrize("seed", range(3))
def test_counted_pairs_hold_all_similar_ones(spark, seed):
    """Sets of all sizes that overlap by about the threshold, in groups of several."""
    r, rows = random.Random(seed), []
    for g in range(40):
        base = [f"g{g}x{k}" for k in range(r.choice((6, 9, 14, 30, 90)))]
        for _ in range(r.randint(2, 6)):
            words = base[:max(1, len(base) - r.randint(0, len(base) // 4))]
            for _ in range(r.randint(0, 1 + len(base) // 30)):
                words[r.randrange(len(words))] = f"n{r.randrange(30)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar_classes(df, bucket_bytes=4096).collect()}
    assert got == brute.op5(rows)


def test_parts_of_a_large_component_meet_once_and_are_copied_little(spark):
    bands = {3: 40, 4: 90, 5: 1, 7: 30}
    rows = [(1000 * b + i, 1, b, "x" * 10) for b, n in bands.items() for i in range(n)]
    members = spark.createDataFrame(rows, "node long, component long, band int, text string")
    cells = jaccard_join._cells(members, F.sum(F.octet_length("text")), 100)
    last = cells.agg(F.max("reach")).first()[0]
    met, at = Counter(), 0
    while at <= last:
        tiles = jaccard_join._met(members, cells, at, at + 2).collect()
        assert max(Counter(x.node for x in tiles).values()) <= 4
        by = {}
        for x in tiles:
            by.setdefault(x.tile, []).append((x.node, x.side))
        for tile in by.values():
            met.update((min(a, b), max(a, b)) for a, s in tile for b, t in tile if a < b and (s == t == 0 or s != t))
        at += 2
    nodes = [(x[0], x[2]) for x in rows]
    want = {(a, b) for a, s in nodes for b, t in nodes if a < b and abs(s - t) <= 1}
    assert set(met) >= want and max(met.values()) == 1


def test_bitmap_of_nodes(spark):
    import numpy as np

    r = random.Random(2)
    nodes = [r.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    bits = jaccard_join.marked(spark.createDataFrame([(x,) for x in nodes], "node long").repartition(3))
    place = jaccard_join._place(np.array(nodes))
    assert all(bits[p >> 3] >> (7 - (p & 7)) & 1 for p in place.tolist())
    assert np.bitwise_count(bits).sum() == len(set(place.tolist()))


def gone(spark, before):
    """Spark removes them in the background."""
    for _ in range(40):
        if not (left := shuffle_files(spark) - before):
            return True
        time.sleep(0.25)
    return not left


def test_the_join_leaves_no_shuffle_files(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df.count()
    before = shuffle_files(spark)
    jaccard_join.similar_classes(df, bucket_bytes=8192).write.parquet(work_path(spark, "test-join"))
    assert gone(spark, before)


def test_the_stage_leaves_no_shuffle_files(spark, rows):
    path = work_path(spark, "test-docs")
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    before = shuffle_files(spark)
    kept = work_path(spark, "test-stage")
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), "").write.parquet(kept)
    assert gone(spark, before)
    want = {i for i, (_, least) in brute.op5(rows).items() if i == least}
    assert {x.doc_id for x in spark.read.parquet(kept).collect()} == want
