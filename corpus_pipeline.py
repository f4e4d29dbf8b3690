"""A training corpus from raw documents, in five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.llm import decontaminate, jaccard_join, mixing, token_orc, toxicity
from accountloom.llm.common import read
from accountloom.session import work_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score reaches 0.3; the model learns from labels of ``docs``."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of every class of linked documents, the one with the smallest id."""
    return jaccard_join.first_of_each_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    return decontaminate.without_hits(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes every document as often as the mixture of sources takes it."""
    return mixing.mixed_documents(docs, (3, 1, 2), 1.5, 2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files, and returns one row per written document, in the order of its start."""
    path = work_path(spark, "tokens")
    token_orc.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_orc.token_index(token_orc.read_tokens(spark, path))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark),
    ("mixing sources", mixture), ("token-ID output", tokens),
]

ORACLE_SQL = None
"""Toxicity and tokenizing have no SQL; the pipeline is tested against plain versions of its stages."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; doc_id, start, n_tokens, ids_crc32 of what is left."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = work_path(spark, f"stage{i + 1}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
