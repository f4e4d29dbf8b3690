"""Connected components of a graph that Spark holds, by alternating stars.

Between two rounds every task joins what it holds by itself, so few rounds go over the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountloom.llm.common import prepare, tidy
from accountloom.session import cut_lineage

CHUNK = 1 << 20
"""Edges that a task joins together; this bounds its memory."""


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of its component, and that least node, among these edges alone."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges that connect the same nodes: a star for each component of a chunk of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= CHUNK:
                yield pa.record_batch(list(map(pa.array, forest(*map(np.concatenate, zip(*held))))), ["a", "b"])
                held, n = [], 0
        if n:
            yield pa.record_batch(list(map(pa.array, forest(*map(np.concatenate, zip(*held))))), ["a", "b"])

    return edges.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
        .unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b, long): the least node that it is joined to.

    Rounds go on until the edges stay as they are; each is written to the checkpoint folder. The
    driver sees a count and a checksum per round. Loops and repeated edges do no harm; an empty
    graph has no components.
    """
    prepare(edges.sparkSession)
    edges = cut_lineage(_contracted(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = cut_lineage(_contracted(_small_star(_large_star(edges))))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
