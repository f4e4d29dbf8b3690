"""Token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of the most frequent segments and their token counts, broadcast
to every task: at most ``frequent`` entries, so its size is fixed (12 bytes a slot). Tier two is a
bounded cache in each Python worker for the segments that the table lacks; each is encoded with
the tokenizer when first met. Texts are never shuffled, nor are their segments: the table comes
from one summary of fixed size per batch of documents, counted over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountloom.llm.common import Table, prepare, tidy
from accountloom.llm.segments import Segmented, encode, row_sums, white_led, worker_cache

FREQUENT = 1 << 18
SUMMARY = 1 << 13
LONGEST = 48


def frequent_segments(docs: DataFrame, text_col: str, frequent: int, summary: int) -> list[str]:
    """The segments that are most frequent over all documents, at most ``frequent``.

    Every batch of documents hands in its ``summary`` most frequent segments of up to ``LONGEST``
    bytes with their counts. The choice affects speed only; counts are exact with any table.
    """
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seg = Segmented(batch.column(0), white_led)
            short = np.flatnonzero(seg.ends - seg.starts <= LONGEST)
            _, first, count = np.unique(seg.hashes[short], return_index=True, return_counts=True)
            top = np.argsort(-count, kind="stable")[:summary]
            yield pa.record_batch([pa.array(seg.strings(short[first[top]]), pa.string()), pa.array(count[top])],
                                  ["segment", "n"])

    told = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(tell), "segment string, n long")
    best = told.groupBy("segment").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "segment").limit(frequent)
    return [r.segment for r in best.select("segment").collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512, frequent: int = FREQUENT, summary: int = SUMMARY) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Counts are those of the tokenizers library over the whole text, without added tokens;
    ``tokenizer_path`` names a byte-level BPE file that every node has. A null text counts as
    empty (0 bytes, 0 tokens); a null id is kept; repeated rows give repeated rows; other columns
    are not read, so their names do not matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    segments = frequent_segments(docs, text_col, frequent, summary)
    table = Table(max(1, (2 * len(segments) + 1).bit_length()), np.int32)
    if segments:
        col = pa.array(segments, pa.string())
        ids = encode(tokenizer_path, segments)
        from accountloom.llm.common import hash_spans, text_buffer

        data, offs = text_buffer(col)
        keys, first = np.unique(hash_spans(data, offs[:-1], offs[1:]), return_index=True)
        table.put(keys, np.array([len(ids[i]) for i in first], np.int32))
    shared = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(tokenizer_path, "counts")
        for batch in batches:
            seg = Segmented(batch.column(1), white_led)
            lengths = shared.value.get(seg.hashes).astype(np.int64)
            miss = np.flatnonzero(lengths < 0)
            lengths[miss] = cache.counts(seg, seg.hashes[miss], miss)
            tokens = row_sums(lengths, seg.first)
            for i in seg.odd.tolist():
                tokens[i] = len(encode(tokenizer_path, [seg.row(i)])[0])
            yield pa.record_batch([batch.column(0), pa.array(np.diff(seg.offs)), pa.array(tokens),
                                   pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) \
        .mapInArrow(tidy(count), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean") \
        .withColumnRenamed("id", id_col)
