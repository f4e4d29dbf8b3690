"""The registered queries of this subpackage: each operator over its whole table, and its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.llm import (
    class_lm, decontaminate, filter_audit, importance, jaccard_join, mixing, phrase_dedup, quality_rules, suffix_dedup,
    token_counts, token_orc, toxicity, warc)
from accountloom.llm.common import read
from accountloom.llm.oracles import ORACLE  # noqa: F401 - read by the entry module
from accountloom.session import work_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), (3, 1, 2), 1.5, 2.0)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    token_orc.write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_orc.token_index(token_orc.read_tokens(spark, path))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "archives")
    pages = read(spark, sf_dir, "pages")
    warc.write_warc(pages, path, min_bytes=0)
    kind = pages.schema["page_id"].dataType
    number = lambda name: F.nullif(F.col(name), F.lit("")).cast(kind).alias(name)  # a null id is written as an empty one
    return warc.read_warc(spark, path).select(
        number("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", number("refers_to"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = class_lm.held_out(F.col("doc_id"))
    scored = class_lm.score(docs, class_lm.train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_mixing, op3_decontaminate, op4_phrase_dedup, op5_jaccard_join, op6_quality_rules,
    op7_token_orc, op8_warc, op9_toxicity, op10_suffix_dedup,
    op11_filter_audit, op12_class_lm, op13_importance)}
