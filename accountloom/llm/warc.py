"""WARC archives with revisit records instead of repeated payloads.

Headers (id, payload digest, payload length) are shuffled by digest without their payloads; the
smallest id of each digest is the original, found by a combined minimum. Revisit records join the
original's header; only originals fetch their payload again, by id. Archives are written by
Spark's text writer with the WARC record end as line separator, so any storage Spark reaches will
do, and a lost executor's files are written again by its committer.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountloom.llm.common import prepare
from accountloom.session import cut_lineage

VERSION = "WARC/1.1"
ARCHIVE_BYTES = 8 << 20
"""Bytes of payload in a file of records of average length."""
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 32 letters, five bits each, from four groups of 40 bits."""
    digest = F.sha1(payload.cast("binary"))
    letters = []
    for g in range(4):
        bits = F.conv(F.substring(digest, 1 + 10 * g, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1))
                    for i in range(8)]
    return F.concat(*letters)


def headers(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(id, url, digest, bytes, mark) of every page; ``mark`` is a quick hash; null payloads are empty."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), base32_sha1(payload).alias("digest"),
                        F.octet_length(payload).cast("long").alias("bytes"), F.xxhash64(payload).alias("mark"))


def originals(heads: DataFrame, min_bytes: int) -> DataFrame:
    """The smallest id of every payload of at least ``min_bytes`` bytes; null ids come last."""
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"))).alias("first")
    return heads.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(first) \
        .select(F.col("digest").alias("o_digest"), F.col("bytes").alias("o_bytes"), F.col("first.id").alias("original"))


def _record(kind: str, extra: Column, content_type: str, length: Column, block: Column) -> Column:
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    lines = [F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.uuid(), F.lit(">")),
             F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                                                          "yyyy-MM-dd'T'HH:mm:ss'Z'")),
             F.concat(F.lit("WARC-Target-URI: "), uri),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
             F.concat(F.lit("X-Page-Id: "), F.coalesce(F.col("id").cast("string"), F.lit(""))),
             F.concat(F.lit("X-Payload-Bytes: "), F.col("bytes").cast("string")), extra,
             F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), length.cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per page: response, or revisit of the smallest id with equal payload.

    Payloads are equal if SHA-1 and length are. Payloads under ``min_bytes`` bytes are always
    responses. A null payload is empty, a null url reads ''; null ids are responses only if no
    other row has the payload; rows that repeat the original's id are responses too. Headers are
    written anew; a URI keeps no line break.
    """
    heads = cut_lineage(headers(pages, id_col, url_col, payload_col))
    total, n = heads.agg(F.sum("bytes"), F.count("*")).first()
    firsts = originals(heads, min_bytes)
    same = (F.col("digest") == F.col("o_digest")) & (F.col("bytes") == F.col("o_bytes"))
    joined = heads.where(F.col("bytes") >= min_bytes).join(firsts, same)
    revisits = joined.where(~F.col("id").eqNullSafe(F.col("original")))
    kept = joined.where(F.col("id").eqNullSafe(F.col("original")))
    if min_bytes > 0:
        kept = kept.unionByName(heads.where(F.col("bytes") < min_bytes), allowMissingColumns=True)
    kept = kept.select(F.col("id").alias("h_id"), "digest", "bytes", F.col("mark").alias("h_mark")).distinct()
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    whole = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(payload).alias("mark"),
                         payload.alias("payload"))
    responses = whole.join(kept, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("mark") == F.col("h_mark")))
    none = F.lit("WARC-Identified-Payload-Type: text/html")
    refers = F.concat_ws("\r\n", F.lit(f"WARC-Profile: {PROFILE}"), F.concat(
        F.lit("X-Refers-To-Page-Id: "), F.coalesce(F.col("original").cast("string"), F.lit(""))))
    records = responses.select(_record("response", none, "text/html; charset=utf-8", F.col("bytes"), F.col("payload"))
                               .alias("value")) \
        .unionByName(revisits.select(_record("revisit", refers, "text/html; charset=utf-8", F.lit(0), F.lit(""))
                                     .alias("value")))
    per_file = max(1, archive_bytes * (n or 1) // max(1, total or 1))
    records.write.mode("overwrite").option("lineSep", RECORD_END).option("compression", "gzip") \
        .option("maxRecordsPerFile", per_file).text(path)


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record in an archive's bytes, by Content-Length."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode().split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        begin = stop + 4
        end = begin + int(fields["Content-Length"])
        if lines[0] != VERSION or raw[end:end + 4] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield fields, raw[begin:end]
        at = end + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``: page_id (text), url, record_type, digest, payload_bytes, refers_to, payload.

    The digest of a response is computed again from its payload and must agree with its header.
    """
    prepare(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        names = ["page_id", "url", "record_type", "digest", "payload_bytes", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for blob in batch.column(0):
                rows = []
                for h, block in parse_records(gzip.decompress(blob.as_py())):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError("payload and digest differ")
                    rows.append((h["X-Page-Id"], h["WARC-Target-URI"], h["WARC-Type"], digest, int(h["X-Payload-Bytes"]),
                                 h.get("X-Refers-To-Page-Id"), block))
                    if len(rows) == 500:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(
        parse, "page_id string, url string, record_type string, digest string, payload_bytes long, refers_to string, "
               "payload binary")
