"""Similarity join of documents on word shingles, in size-banded tiles with bitmap signatures.

1. Every document's shingles are put in one global order, rare before frequent, then by hash. Two
   documents that reach the threshold share a shingle among the first of each, its prefix. Prefixes
   are dealt into buckets as packed numbers. What two documents have in common beyond their
   prefixes is bounded by their sizes, so the prefixes of a similar pair share a certain number of
   shingles, not one only. A bucket counts what pairs share, a second dealing adds that up, and
   pairs with fewer are no ties. Shingles of many documents are not counted, as that takes a record
   per pair: they tie all documents of compatible size, by one edge per document.
2. Components of the ties are tiles: pairs to compare never cross them. A large one is cut into
   bands of set size, a factor of the threshold wide, so that only a band and the next are
   compared, and bands into parts. Its parts meet in rounds, each of which copies texts no more
   than a few times, until all its documents are joined or all parts have met.
3. In a tile, documents are compared by hashed bitmaps of their shingles: a bit that one has and
   the other lacks is a shingle not shared, which bounds the overlap from above. Pairs that pass,
   and are not joined already, are decided by intersecting the sorted arrays.

Equal texts are one node from the start, named by a hash of the lower-cased text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accountloom.llm.common import (
    LOWER, WHITE, Table, buckets_for, flat_ranges, gram_hashes, hash_spans, mix, pieces, prepare, spans_of, text_buffer, tidy)
from accountloom.llm.components import components
from accountloom.llm.repeats import _batch, _joined, _packed
from accountloom.session import cut_lineage, work_path

SHINGLE = 5
PERCENT = 75
BUCKET_BYTES = 8 << 20
"""Bytes of text per bucket."""
TILE_BYTES = 16 << 20
"""Bytes of text that a tile holds of either of its sides, but for a longer document."""
FREQUENT = 1 << 20
"""How many frequent shingles are moved to the end of the order; 18 to 36 bytes each are broadcast."""
RARE = 3
"""Shingles that occur less often than this are not moved."""
ENOUGH = 1 << 31
"""What the records of a pair add up to if its prefixes share as many shingles as a similar pair's do."""
COUNTED = 4
"""Postings of a bucket for each pair that it counts: what counting adds to the shuffle is a part of the postings."""
MARKS = 26
"""The bitmap of tied documents has two to this power of bits."""
ROWS = 1 << 14
_KEY = 46


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle; a shorter row is one shingle, if it has words."""
    n = np.diff(first)
    many = np.maximum(n - size + 1, 0)
    rows = [np.repeat(np.arange(len(n)), many)]
    hashes = [gram_hashes(words, size)[flat_ranges(first[:-1], many)] if many.any() else np.zeros(0, np.uint64)]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            rows.append(short)
            hashes.append(mix(gram_hashes(words, k)[first[short]] + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(hashes)


def sets_of(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends = spans_of(data, offs, WHITE)
    return shingle_hashes(hash_spans(data, starts, ends), np.searchsorted(starts, offs), size)


def _by_piece(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    for lo, hi in pieces(offs):
        for a in range(lo, hi, ROWS):
            yield a, min(hi, a + ROWS)


def _once(nodes: np.ndarray, seen: set) -> np.ndarray:
    """Which rows hold a node that this task has not met; the set is kept small."""
    if len(seen) > 1 << 18:
        seen.clear()
    out = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes.tolist()):
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


def _only(data: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.diff(offs)[keep]
    return data[flat_ranges(offs[:-1][keep], length)] if not keep.all() else data, np.concatenate([[0], np.cumsum(length)])


_COUNTS = pa.schema([("bucket", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("n", pa.binary())])
_POSTINGS = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("node", pa.binary()), ("size", pa.binary())])
_SHARES = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("share", pa.binary())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def frequent_shingles(nodes: DataFrame, size: int, n: int, most: int, rare: int) -> Table:
    """Classes of shingles by frequency over all documents: 1 + log2 of n / ``rare``; 0 if absent.

    Only the lower half of the hashes is counted: prefixes lie there, as the order is by hash.
    Without these classes the join would be as exact, only slower, so the table may be cut at the
    ``most`` frequent.
    """
    half = np.uint64(1 << (_KEY - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            data, offs = _only(*text_buffer(batch.column(1)), _once(batch.column(0).to_numpy(), seen))
            keys = []
            for lo, hi in _by_piece(offs):
                _, h = sets_of(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], size)
                h >>= np.uint64(64 - _KEY)
                keys.append(h[h < half])
            keys, found = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
            g = mix(keys)
            if len(keys):
                yield _batch(list(_packed(((g >> np.uint64(32)) % np.uint64(n)).astype(np.int64), n, {
                    "low": keys.astype(np.uint32), "high": (keys >> np.uint64(32)).astype(np.uint16),
                    "n": np.minimum(found, 255).astype(np.uint8)})), _COUNTS)

    def total(table: pa.Table) -> pa.Table:
        keys = _joined(table, "low", "<u4").astype(np.uint64) | (_joined(table, "high", "<u2").astype(np.uint64) << np.uint64(32))
        keys, back = np.unique(keys, return_inverse=True)
        found = np.bincount(back, weights=_joined(table, "n", "u1"))
        often = found >= rare
        return pa.table({"key": pa.array(keys[often].astype(np.int64)), "n": pa.array(found[often].astype(np.int64))})

    best = nodes.select("node", "text").mapInArrow(tidy(count), "bucket int, low binary, high binary, n binary") \
        .groupBy("bucket").applyInArrow(tidy(total), "key long, n long").orderBy(F.desc("n"), "key").limit(most).toArrow()
    keys = best.column("key").to_numpy().astype(np.uint64)
    table = Table(max(4, (2 * len(keys) + 1).bit_length()), np.int8)
    table.put(mix(keys + np.uint64(1)), (1 + np.log2(best.column("n").to_numpy() / rare)).astype(np.int8).clip(1, 14))
    return table


def prefixes(row: np.ndarray, hashes: np.ndarray, rows: int, classes: Table, percent: int):
    """Row, key and set size of every prefix shingle."""
    key = hashes >> np.uint64(64 - _KEY)
    kind = np.maximum(classes.get(mix(key + np.uint64(1))), 0).astype(np.uint64)
    packed = np.unique((row.astype(np.uint64) << np.uint64(_KEY + 4)) | (kind << np.uint64(_KEY)) | key)
    row = (packed >> np.uint64(_KEY + 4)).astype(np.int64)
    size = np.bincount(row, minlength=rows)
    turn = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    need = -(-size * percent // 100)  # of a set of this size, so many are shared at least
    keep = turn < (size - need + 1)[row]
    return row[keep], packed[keep] & np.uint64((1 << _KEY) - 1), size[row[keep]]


def _shared_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles the prefixes of a similar pair share at least; ``a`` and ``b`` are the set sizes.

    The prefix that ends first in the order holds all that both have up to there, and so does the
    other one: what else they have in common lies beyond the former.
    """
    beyond = -(-np.maximum(a, b) * percent // 100) - 1
    return np.maximum(-(-percent * (a + b) // (100 + percent)) - beyond, 1)


def _summed(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every pair once, with the sum of its shares, ``ENOUGH`` at most."""
    order = np.lexsort((b, a))
    a, b, share = a[order], b[order], share[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[:len(a)])
    total = np.add.reduceat(share, head) if len(head) else share
    return a[head], b[head], np.minimum(total, ENOUGH)


def _ties(table: pa.Table, percent: int, n: int) -> pa.Table:
    """Pairs of documents of one bucket that share prefix shingles, with their part of what a similar pair shares.

    One pair is counted for ``COUNTED`` postings of the bucket, those of the rarest shingles. Documents
    with any other shingle in common are tied as they are, by edges to the least of them.
    """
    key, node, size = _joined(table, "key", "<u4"), _joined(table, "node", "<i8"), _joined(table, "size", "<i4")
    sure, size = size < 0, np.abs(size.astype(np.int64))
    order = np.lexsort((node, size, key))
    key, node, size, sure = key[order], node[order], size[order], sure[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])[:len(key)]
    key, node, size, sure = key[once], node[once], size[once], sure[once]
    tied = (key[1:] == key[:-1]) & (100 * size[:-1] >= percent * size[1:])
    head = np.flatnonzero(np.concatenate([[True], ~tied])[:len(key)])
    many = np.diff(np.append(head, len(key)))
    order = np.argsort(many, kind="stable")
    counted = np.zeros(len(head), bool)
    counted[order] = np.cumsum((many * (many - 1) // 2)[order]) <= len(key) // COUNTED

    least = np.repeat(np.minimum.reduceat(node, head) if len(head) else node, many)
    left = np.flatnonzero(np.repeat(~counted, many) & (least != node))
    found = [(least[left], node[left], np.full(len(left), ENOUGH))]
    end, left, step = np.repeat(head + many, many), np.flatnonzero(np.repeat(counted, many)), 0
    while len(left):
        step += 1
        left = left[left + step < end[left]]
        x = left[100 * size[left] >= percent * size[left + step]]
        y = x + step
        need = np.where(sure[x] | sure[y], 1, _shared_at_least(size[x], size[y], percent))
        found.append((np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), -(-ENOUGH // need)))
    a, b, share = _summed(*(np.concatenate(x) for x in zip(*found)))
    bucket = ((mix(a.view(np.uint64) ^ mix(b.view(np.uint64))) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    return pa.Table.from_batches([_batch(list(_packed(bucket, n, {"a": a, "b": b, "share": share.astype(np.uint32)})), _SHARES)])


def _tied(table: pa.Table) -> pa.Table:
    """The pairs of a bucket that share enough."""
    a, b, share = _summed(_joined(table, "a", "<i8"), _joined(table, "b", "<i8"),
                          _joined(table, "share", "<u4").astype(np.int64))
    return pa.table([pa.array(a[share >= ENOUGH]), pa.array(b[share >= ENOUGH])], schema=_EDGES)


def candidate_edges(nodes: DataFrame, classes, size: int, percent: int, n: int) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            fresh = _once(batch.column(0).to_numpy(), seen)
            node = batch.column(0).to_numpy()[fresh]
            data, offs = _only(*text_buffer(batch.column(1)), fresh)
            got = []
            for lo, hi in _by_piece(offs):
                row, h = sets_of(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], size)
                row, key, length = prefixes(row, h, hi - lo, classes.value, percent)
                g = mix(key)
                # Of two keys that look alike in a bucket one would not count: such a document needs one shared key only.
                name = np.sort((row.astype(np.uint64) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF)))
                twice = np.unique(name[1:][name[1:] == name[:-1]] >> np.uint64(32)).astype(np.int64)
                got.append((row + lo, g, np.where(np.isin(row, twice), -length, length) if len(twice) else length))
            if got:
                row, g, length = (np.concatenate(x) for x in zip(*got))
                yield _batch(list(_packed(((g >> np.uint64(32)) % np.uint64(n)).astype(np.int64), n, {
                    "key": g.astype(np.uint32), "node": node[row], "size": length.astype(np.int32)})), _POSTINGS)

    return nodes.select("node", "text").mapInArrow(tidy(deal), "bucket int, key binary, node binary, size binary") \
        .groupBy("bucket").applyInArrow(tidy(lambda t: _ties(t, percent, n)), "bucket int, a binary, b binary, share binary") \
        .groupBy("bucket").applyInArrow(tidy(_tied), "a long, b long")


def similar_edges(node: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the same documents as all links do, among sorted sets; see the module.

    ``side`` is 0 for all, or 1 and 2: then only pairs across are compared.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    node, side, size, sets = node[order], side[order], size[order], [sets[i] for i in order]
    if not len(size):
        return []
    bits = 1 << min(15, max(9, int(2 * size.max()).bit_length()))
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    maps = np.zeros((len(sets), bits // 8), np.uint8)
    place = (flat % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(maps, (row, place >> 3), (1 << (place & 7)).astype(np.uint8))
    maps = maps.view(np.uint64)
    label, out = np.arange(len(sets)), []
    stop = np.searchsorted(size, size * 100 // percent, side="right")
    for i in range(len(sets)):
        j = np.arange(i + 1, stop[i])
        j = j[(label[j] != label[i]) & ((side[j] == 0) | (side[j] != side[i]))]
        if not len(j):
            continue
        need = -(-percent * (size[i] + size[j]) // (100 + percent))
        for at in range(0, len(j), 4096):
            part = j[at:at + 4096]
            lacks = np.bitwise_count(maps[i] & ~maps[part]).sum(1, dtype=np.int64)
            extra = np.bitwise_count(maps[part] & ~maps[i]).sum(1, dtype=np.int64)
            bound = np.minimum(size[i] - lacks, size[part] - extra)
            for k in part[bound >= need[at:at + 4096]].tolist():
                if label[k] == label[i]:
                    continue
                found = np.searchsorted(sets[k], sets[i])
                shared = int((sets[k][np.minimum(found, len(sets[k]) - 1)] == sets[i]).sum())
                if 100 * shared >= percent * (size[i] + size[k] - shared):
                    out.append((int(node[i]), int(node[k])))
                    label[label == label[k]] = label[i]
    return out


def set_sizes(col: pa.Array, size: int) -> np.ndarray:
    """Size of every text's set."""
    data, offs = text_buffer(col)
    out = [np.zeros(0, np.int64)]
    for lo, hi in _by_piece(offs):
        row, h = sets_of(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], size)
        packed = np.unique((row.astype(np.uint64) << np.uint64(50)) | (h >> np.uint64(14)))
        out.append(np.bincount((packed >> np.uint64(50)).astype(np.int64), minlength=hi - lo))
    return np.concatenate(out)


def _place(nodes: np.ndarray) -> np.ndarray:
    return (nodes.view(np.uint64) >> np.uint64(64 - MARKS)).astype(np.int64)


def marked(nodes: DataFrame) -> np.ndarray:
    """A bitmap that has a bit set for every node, which are hashes; some others share a bit with one."""
    block = 15

    def bits(table: pa.Table) -> pa.Table:
        place = _place(table.column("node").to_numpy())
        out = np.zeros(1 << block, bool)
        out[place & ((1 << block) - 1)] = True
        return pa.table({"block": pa.array(place[:1] >> block), "bits": pa.array([np.packbits(out).tobytes()], pa.binary())})

    out = np.zeros((1 << (MARKS - block), 1 << (block - 3)), np.uint8)
    found = nodes.select("node").groupBy(F.shiftrightunsigned("node", 64 - MARKS + block)) \
        .applyInArrow(tidy(bits), "block long, bits binary").toArrow()
    for k, x in zip(found.column("block").to_pylist(), found.column("bits").to_pylist()):
        out[k] = np.frombuffer(x, np.uint8)
    return out.reshape(-1)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT,
          bucket_bytes: int = BUCKET_BYTES, tile_bytes: int = TILE_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """(a, b): links between different texts, by node, that connect all that similar pairs connect."""
    spark = docs.sparkSession
    prepare(spark)
    nodes = with_node(docs, id_col, text_col).where("text != ''").select("node", "text")
    total = nodes.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = buckets_for(total, bucket_bytes)
    classes = spark.sparkContext.broadcast(frequent_shingles(nodes, size, n, frequent, RARE))
    tied = cut_lineage(components(candidate_edges(nodes, classes, size, percent, n)))
    classes.destroy()
    marks = spark.sparkContext.broadcast(marked(tied))

    def once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            place = _place(batch.column(0).to_numpy())
            batch = batch.filter(pa.array((marks.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)))
            batch = batch.filter(pa.array(_once(batch.column(0).to_numpy(), seen)))
            if batch.num_rows:
                band = np.log(np.maximum(set_sizes(batch.column(1), size), 1)) / math.log(100 / percent)
                yield pa.record_batch([*batch.columns, pa.array(np.floor(band).astype(np.int32))], ["node", "text", "band"])

    # One copy of every node that has a tie; join and grouping share one shuffle of these texts.
    members = nodes.mapInArrow(tidy(once_per_task), "node long, text string, band int").join(tied, "node") \
        .groupBy("node").agg(F.first("component").alias("component"), F.first("band").alias("band"), F.first("text").alias("text"))
    path = work_path(spark, "members")
    members.write.parquet(path)
    marks.destroy()
    members = spark.read.schema("node long, component long, band int, text string").parquet(path)
    weight = F.sum(F.octet_length("text").cast("long"))
    large = cut_lineage(members.groupBy("component").agg(weight.alias("bytes")).where(F.col("bytes") > tile_bytes))

    def compare(table: pa.Table) -> pa.Table:
        found = [] if table.num_rows < 2 else similar_edges(
            table.column("node").to_numpy(), _sets(table.column("text"), size), table.column("side").to_numpy(), percent)
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                        schema=_EDGES)

    def compared(tiles: DataFrame) -> DataFrame:
        return tiles.groupBy("tile").applyInArrow(tidy(compare), "a long, b long")

    # There are at most total / tile_bytes large components, and few cells in each.
    found = cut_lineage(compared(members.join(F.broadcast(large.select("component")), "component", "left_anti").select(
        F.col("component").cast("string").alias("tile"), F.lit(0).alias("side"), "node", "text")))
    cells, at = None, 0
    while left := large.agg(F.sum("bytes")).first()[0]:
        if not at:
            cells = _cells(members.join(F.broadcast(large.select("component")), "component"), weight, tile_bytes)
        to = at + max(2, total // (2 * left))  # so many cells away each cell meets others in this round
        now = cells.join(F.broadcast(large.select("component")), "component", "left_semi")
        found = cut_lineage(found.unionByName(compared(_met(members, now, at, to))))
        joined = members.select("node", "component").join(F.broadcast(large.select("component")), "component") \
            .join(components(found).withColumnRenamed("component", "class"), "node", "left") \
            .groupBy("component").agg(F.countDistinct(F.coalesce("class", "node")).alias("classes"))
        more = cells.groupBy("component").agg(F.max("reach").alias("reach")).where(F.col("reach") >= to)
        large = cut_lineage(large.join(joined.where("classes > 1"), "component", "left_semi").join(more, "component", "left_semi"))
        at = to
    return found


def _cells(members: DataFrame, weight: Column, tile_bytes: int) -> DataFrame:
    """Bands of every component, whose parts are numbered from ``first``: a band's meet each other and the next band's.

    They are the parts from ``low`` to before ``high``, none of them more than ``reach`` away.
    """
    cells = members.groupBy("component", "band").agg(F.ceil(weight / tile_bytes).cast("int").alias("parts"))
    turn = Window.partitionBy("component").orderBy("band")
    cells = cells.withColumn("first", F.sum("parts").over(turn) - F.col("parts")).withColumn("end", F.col("first") + F.col("parts"))
    low = F.when(F.lag("band").over(turn) == F.col("band") - 1, F.lag("first").over(turn)).otherwise(F.col("first"))
    high = F.when(F.lead("band").over(turn) == F.col("band") + 1, F.lead("end").over(turn)).otherwise(F.col("end"))
    return cut_lineage(cells.withColumn("low", low).withColumn("high", high)
                       .withColumn("reach", F.col("high") - F.col("first") - 1))


def _met(members: DataFrame, cells: DataFrame, at: int, to: int) -> DataFrame:
    """Tiles of two parts that are ``at`` to before ``to`` apart, each text in those of its part."""
    own = members.join(F.broadcast(cells), ["component", "band"]) \
        .withColumn("cell", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")))

    def others(side: int, least: int, most: Column) -> Column:
        most = F.least(F.lit(to - 1).cast("long"), most.cast("long"))
        apart = F.when(most >= least, F.sequence(F.lit(least).cast("long"), most)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(apart, lambda d: F.struct(
            F.concat_ws("/", "component", F.col("cell") - (d if side == 2 else F.lit(0)), d).alias("tile"),
            F.when(d == 0, 0).otherwise(side).alias("side")))

    met = F.concat(others(1, at, F.col("high") - 1 - F.col("cell")), others(2, max(at, 1), F.col("cell") - F.col("low")))
    return own.select("node", "text", F.explode(met).alias("met")).select("met.tile", "met.side", "node", "text")


def _sets(texts: pa.ChunkedArray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    out = []
    for chunk in texts.chunks:
        data, offs = text_buffer(chunk)
        for lo, hi in _by_piece(offs):
            row, h = sets_of(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], size)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[:len(h)]
            out += np.split(h[new], np.cumsum(np.bincount(row[new], minlength=hi - lo))[:-1])
    return out


def with_node(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")) \
        .withColumn("node", F.xxhash64(F.translate("text", upper, upper.lower())))


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                        percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest id of their class.

    Documents without words are classes of their own. Of rows that repeat id and text one stays;
    a null id stays only where its class has no other.
    """
    found = similar_classes(docs, id_col, text_col, size, percent)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    stays = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(name.alias("name")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"),
                       F.xxhash64(text_col).alias("same"))
    turn = F.row_number().over(Window.partitionBy("name", "same").orderBy("same"))
    return rows.join(stays, "name", "left_semi").withColumn("turn", turn).where("turn = 1").select("row.*")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
            percent: int = PERCENT, bucket_bytes: int = BUCKET_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Per document: ``id_col``, n_shingles and component_id, the smallest id it is linked to.

    Words are lower-cased in A-Z and end at ASCII white space; a document's set holds its shingles
    of ``size`` words, or its whole sequence if shorter. Two documents are linked where 100 times
    the intersection is at least ``percent`` times the union. Documents without words, null texts
    among them, are linked with nothing. A null id is never the smallest unless a class has no
    other; repeated rows are linked with each other and give equal rows; other columns are not
    read; an empty table gives an empty result.
    """
    joined = components(links(docs, id_col, text_col, size, percent, bucket_bytes, tile_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(set_sizes(batch.column(2), size))],
                                  ["id", "node", "n_shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut_lineage(with_node(docs, id_col, text_col).select("id", "node", "text")
                       .mapInArrow(tidy(count), f"id {kind}, node long, n_shingles long"))
    # Classes are settled among texts, so the many copies of one text meet in no group of rows.
    texts = rows.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least")) \
        .join(joined, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = texts.groupBy("class").agg(F.min("least").alias("component_id"))
    found = texts.select("node", "class").join(least, "class").select("node", F.struct("component_id").alias("found"))
    return rows.join(found, "node", "left").select(F.col("id").alias(id_col), "n_shingles", F.when(
        F.col("found").isNull(), F.col("id")).otherwise(F.col("found.component_id")).alias("component_id"))
