"""Token ids in ORC files: run-length coded integers, row indexes and Bloom filters on the ids.

Documents are range-partitioned by id, so every file and stripe covers a narrow range of ids.
A reader takes stripes in parallel and skips those whose statistics or Bloom filter exclude the
wanted documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accountloom.llm.common import prepare, buckets_for, flat_ranges, text_bytes, tidy
from accountloom.llm.segments import Segmented, bare, encode, worker_cache
from accountloom.session import cut_lineage

FILE_BYTES = 16 << 20
STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1000
ORDER_BITS = 33
"""monotonically_increasing_id keeps the partition above these bits and the row below."""


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(id, text) to (id, ids array<int>), in the order of the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(tokenizer_path, "ids")
        tail = np.zeros(0, np.int32) if end_id is None else np.array([end_id], np.int32)
        for batch in batches:
            seg = Segmented(batch.column(1), bare)
            pool, start, length = cache.ids(seg)
            flat = pool[flat_ranges(start, length)]
            ends = np.concatenate([[0], np.cumsum(length)])[seg.first]
            odd = {i: np.array(encode(tokenizer_path, [seg.row(i)])[0], np.int32) for i in seg.odd.tolist()}
            rows = []
            for i in range(len(batch)):
                rows += [odd[i] if i in odd else flat[ends[i]:ends[i + 1]], tail]
            sizes = [len(rows[2 * i]) + len(tail) for i in range(len(batch))]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else tail[:0]))
            yield pa.record_batch([batch.column(0), ids], ["id", "ids"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"id {kind}, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int | None = 1, file_bytes: int = FILE_BYTES) -> None:
    """Encode every text and write ORC files in ascending id order under ``path``.

    Columns: ``place`` (a long that ascends in the order of writing), ``id_col`` and ``ids``. A
    null text is empty and holds only ``end_id``; null ids stand first; repeated rows are written
    as often as they occur, ties on the id standing in the order of a hash of the text.
    """
    prepare(docs.sparkSession)
    total = docs.agg(F.sum(text_bytes(text_col))).first()[0] or 0
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = rows.repartitionByRange(buckets_for(total, file_bytes), "id", "tie") \
        .sortWithinPartitions("id", "tie").select("id", "text")
    encode_texts(ordered, tokenizer_path, end_id) \
        .select(F.monotonically_increasing_id().alias("place"), F.col("id").alias(id_col), "ids") \
        .write.option("orc.bloom.filter.columns", id_col).option("orc.create.index", "true") \
        .option("orc.row.index.stride", INDEX_STRIDE).option("orc.stripe.size", STRIPE_BYTES) \
        .option("orc.bloom.filter.fpp", 0.01).mode("overwrite").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files back as a table; filters on the id skip stripes and row groups."""
    return spark.read.orc(path)


def token_index(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: ``id_col``, start (ids of all before it), n_tokens, ids_crc32.

    Starts are prefix sums inside each written block, plus the total of the blocks before it; the
    only window without a key runs over one row per block.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            offs = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(offs).astype(np.int64)),
                                   pa.array(crc, pa.int64())], ["place", "id", "n_tokens", "ids_crc32"])

    kind = tokens.schema[id_col].dataType.simpleString()
    rows = cut_lineage(tokens.select("place", F.col(id_col).alias("id"), "ids")
                       .mapInArrow(tidy(digest), f"place long, id {kind}, n_tokens long, ids_crc32 long")) \
        .withColumn("block", F.shiftright("place", ORDER_BITS))
    blocks = rows.groupBy("block").agg(F.sum("n_tokens").alias("sum"))
    before = blocks.select("block", (F.sum("sum").over(Window.orderBy("block")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("block").orderBy("place")
    return rows.withColumn("within", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(before, "block") \
        .select(F.col("id").alias(id_col), (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
