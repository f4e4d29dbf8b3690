"""Where long sequences repeat across documents: the search that both exact dedup operators share.

A sequence is ``window`` units long; units are words or bytes. Each window names the least hash
among its ``gram``-unit pieces, its anchor. Equal windows name equal anchors at equal places, so a
window can repeat only if its anchor does. Neighbouring windows mostly share an anchor: a run.

1. Documents with equal text are settled by digest; only the first of them goes on.
   A run's stretch is all units of its windows.
2. Anchors are dealt into buckets by hash, as packed numbers, each with a hash of its stretch. A
   bucket settles equal stretches: all but the earliest start earlier elsewhere. Where an anchor
   has several stretches, one of each goes on.
3. Those are dealt into shards by anchor, units and all, and a solver of the operator's own finds,
   exactly, which windows start earlier elsewhere. Of a hot anchor, one with very many stretches,
   no stretch is sent: each of its windows goes by its own hash to any shard, which settles equal
   ones like a bucket settles equal stretches.
4. The verdicts go back to the documents by key.

Hot anchors, stretches and windows do not pile up: a batch settles its own equal ones, and hands
in at most ``VARIANTS`` runs of any anchor to its bucket. The others go on, and since their anchor
is then hot for its bucket, too, all its windows meet. Buckets and shards are as many as the size
of the input asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountloom.llm.common import (
    _P, _powers, buckets_for, flat_ranges, gram_hashes, hash_spans, mix, pieces, prepare, text_buffer, tidy)

BUCKET_BYTES = 6 << 20
"""Bytes of text per shard; a bucket, whose records are smaller, takes four times as many."""
VARIANTS = 64
"""How many runs of an anchor a batch hands in to the anchor's bucket; an anchor with more is hot."""
HOT = 4096
"""An anchor of which a bucket sends on more runs is hot, too: its windows are dealt one by one."""
SLICE = 1 << 14
"""So many runs of hot anchors are cut into windows together."""
STEP = 1 << 19
LAST = (1 << 63) - 1


class Units(NamedTuple):
    """What a sequence is made of, and how long it is."""

    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    """Bytes and row offsets to units (integers) and the index of the first unit of every row."""
    window: int
    gram: int
    dtype: str
    """Type in which units are sent to the shards."""
    within: bool
    """Whether an earlier start in the same document counts, too."""


class Stretches(NamedTuple):
    """Distinct stretches of units of one shard; one of m units holds m - window + 1 windows.

    A stretch stands for its earliest place; they are in order of place (rank, key, at).
    """

    units: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    anchors: np.ndarray
    """Place of the anchor, from the start of the stretch."""
    counts: np.ndarray
    """In how many places the stretch stands."""


def anchor_runs(units: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: row, start, number of windows, place and hash of the
    anchor, hash of the stretch."""
    found: list[tuple] = []
    width = window - gram + 1
    usable = np.maximum(np.diff(first) - window + 1, 0)
    for lo in range(0, len(units) - window + 1, STEP):
        part = units[lo:lo + STEP + window - 1].astype(np.uint64)
        hashes = gram_hashes(part + np.uint64(1), gram)
        least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[:have - width], least[width - have:])
        row = np.arange(max(0, np.searchsorted(first, lo, side="right") - 1), np.searchsorted(first, lo + len(least)))
        row = row[row < len(usable)]
        begin = np.maximum(first[row] - lo, 0)
        end = np.minimum(first[row] + usable[row] - lo, len(least))
        row, begin, end = row[end > begin], begin[end > begin], end[end > begin]
        if not len(row):
            continue
        change = np.flatnonzero(least[1:] != least[:-1]) + 1
        starts = np.union1d(begin, change)
        owner = np.searchsorted(begin, starts, side="right") - 1
        good = (owner >= 0) & (starts < end[owner])
        starts, owner = starts[good], owner[good]
        stop = np.minimum(np.append(starts[1:], len(least)), end[owner])
        place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        up, down = _powers(_P, len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[:len(part)], out=sums[1:])
        whole = mix((sums[stop + window - 1] - sums[starts]) * down[starts] + (stop - starts).astype(np.uint64))
        found.append((row[owner], starts + lo, stop - starts, place + lo, mix(hashes[place] ^ np.uint64(window)), whole))
    if not found:
        none, no_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, none, none, none, no_hash, no_hash
    return tuple(np.concatenate(x) for x in zip(*found))


def _packed(buckets: np.ndarray, n: int, arrays: dict[str, np.ndarray]) -> Iterator[dict[str, object]]:
    """One record per bucket that occurs, each array as bytes."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(n + 1))
    arrays = {k: v[order] for k, v in arrays.items()}
    for b in np.flatnonzero(np.diff(edges)):
        yield {"bucket": int(b)} | {k: _planes(v[edges[b]:edges[b + 1]]) for k, v in arrays.items()}


def _batch(records: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema)


def _planes(values: np.ndarray) -> bytes:
    """An array as bytes, all first bytes first: what the high bytes repeat then compresses well."""
    k = values.itemsize
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, k).T.tobytes()


def _joined(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    """The arrays of a column, one after the other; see ``_planes``."""
    k = np.dtype(dtype).itemsize
    raw = [np.frombuffer(x.as_buffer(), np.uint8) for c in table.column(name).chunks for x in c if x.as_buffer().size]
    if not raw:
        return np.zeros(0, dtype)
    return np.concatenate([x.reshape(k, -1).T for x in raw]).reshape(-1).view(dtype)


_ANCHORS = pa.schema([("bucket", pa.int32()), *[(n, pa.binary()) for n in (
    "hash", "whole", "more", "key", "rank", "runs", "start", "size", "kind")]])
_FOUND = pa.schema([("key", pa.int64()), ("run", pa.int64())])
OPEN, SEVERAL, ON, GONE = 0, 1, 2, 3
"""Of a run: not known to repeat; its batch has runs of its anchor that go on unseen; goes on; settled."""
_RUNS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in (
    "units", "length", "anchor", "rank", "key", "at")]])
STRETCH, KNOWN, WINDOWS = 0, 1, 2
"""What is sent: stretches; runs that are settled; windows of hot anchors, by name in place of units."""


def _ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "bigint", "binary": "binary"}
    return ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema)


def _settle(h: np.ndarray, whole: np.ndarray, rank: np.ndarray, key: np.ndarray, start: np.ndarray,
            u: Units) -> tuple[np.ndarray, np.ndarray]:
    """(gone, head) of runs: those whose stretch stands earlier among them, and the first of each stretch."""
    name = mix(h) ^ whole
    _, at, back, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    gone, head = np.zeros(len(h), bool), np.zeros(len(h), bool)
    head[at] = True
    many = np.flatnonzero(count[back] > 1)
    if len(many):
        order = many[np.lexsort((start[many], key[many], rank[many], back[many]))]
        new = np.concatenate([[True], back[order[1:]] != back[order[:-1]]])
        head[many] = False
        head[order[new]] = True
        least = order[new][np.cumsum(new) - 1]
        gone[order] = rank[order] > rank[least]
        if u.within:
            gone[order] |= (key[order] != key[least]) | (start[order] != start[least])
    return gone, head


def _anchors(docs: DataFrame, u: Units, n: int) -> DataFrame:
    """(key, id, rank, text) to packed anchors by bucket; ``runs`` counts those of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ranks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            data, offs = text_buffer(batch.column(3))
            got = []
            for lo, hi in pieces(offs):
                units, first = u.split(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                row, start, size, _, h, whole = anchor_runs(units, first, u.window, u.gram)
                got.append((row + lo, start - first[row], size, h, whole))
            if not got or not sum(len(x[0]) for x in got):
                continue
            row, start, size, h, whole = (np.concatenate(x) for x in zip(*got))
            rank, key = ranks[row], keys[row]
            gone, head = _settle(h, whole, rank, key, start, u)
            kind = np.where(gone, GONE, OPEN).astype(np.uint8)
            # Runs of one anchor: the first go to its bucket, the others go on at once, and are hot.
            live = np.flatnonzero(~gone)
            live = live[np.argsort(h[live], kind="stable")]
            new = np.concatenate([[True], h[live[1:]] != h[live[:-1]]])
            turn = np.arange(len(live)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > VARIANTS
            kind[live[several]] = SEVERAL
            kind[live[turn >= VARIANTS]] = ON
            spread = mix(key.view(np.uint64) + start.astype(np.uint64))
            bucket = ((np.where(kind >= ON, spread, h) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
            order = np.lexsort((start, row, bucket))
            bucket, row = bucket[order], row[order]
            edges = np.searchsorted(bucket, np.arange(n + 1))
            columns = {"hash": h.astype(np.uint32), "whole": whole.astype(np.uint32),
                       "more": (whole >> np.uint64(32)).astype(np.uint8), "start": start.astype(np.int32),
                       "size": size.astype(np.uint8), "kind": kind}
            columns = {k: v[order] for k, v in columns.items()}
            records = []
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                own, count = np.unique(row[part], return_counts=True)
                records.append({"bucket": int(b), "key": _planes(keys[own]), "rank": _planes(ranks[own]),
                                "runs": _planes(count.astype(np.int32))} | {k: _planes(v[part]) for k, v in columns.items()})
            yield _batch(records, _ANCHORS)

    return docs.mapInArrow(tidy(run), _ddl(_ANCHORS))


def _repeating(u: Units) -> Callable[[pa.Table], pa.Table]:
    """The runs of a bucket that go on, and those that are settled (lowest bit); the next bit marks hot ones."""
    def run(table: pa.Table) -> pa.Table:
        h = _joined(table, "hash", "<u4").astype(np.uint64)
        whole = _joined(table, "whole", "<u4").astype(np.uint64) | (_joined(table, "more", "u1").astype(np.uint64) << np.uint64(32))
        start, size = _joined(table, "start", "<i4").astype(np.int64), _joined(table, "size", "u1").astype(np.int64)
        runs, kind = _joined(table, "runs", "<i4"), _joined(table, "kind", "u1")
        key, rank = np.repeat(_joined(table, "key", "<i8"), runs), np.repeat(_joined(table, "rank", "<i8"), runs)
        gone, on = kind == GONE, kind == ON
        hot = on.copy()
        own = np.flatnonzero(kind < ON)
        lost, _ = _settle(h[own], whole[own], rank[own], key[own], start[own], u)
        gone[own[lost]] = True
        left = own[~lost]
        # An anchor whose stretches are all equal is settled; else what is left goes on.
        left = left[np.argsort(h[left], kind="stable")]
        new = np.concatenate([[True], h[left[1:]] != h[left[:-1]]])[:len(left)]
        group = np.cumsum(new) - 1
        low, high = (f(whole[left], np.flatnonzero(new)) for f in (np.minimum.reduceat, np.maximum.reduceat)) \
            if len(left) else (whole[left], whole[left])
        # Runs that went on unseen may equal any of the anchor's, also where those handed in with them are lost.
        known = np.isin(h[left], h[own[kind[own] == SEVERAL]])
        hot[left[known | ((low != high) & (np.bincount(group, minlength=len(low)) > HOT))[group]]] = True
        on[left[(low != high)[group] | known]] = True
        some = np.flatnonzero(gone | on)
        found = (start[some] << 10) | (size[some] << 2) | (hot[some].astype(np.int64) << 1) | gone[some]
        return pa.table([pa.array(key[some]), pa.array(found)], schema=_FOUND)

    return run


def _stretches(docs: DataFrame, u: Units, n: int) -> DataFrame:
    """(key, rank, text, runs) to packed stretches by shard, and to runs known to start earlier elsewhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ranks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offs = text_buffer(batch.column(2))
            runs = batch.column(3)
            edge, flat = runs.offsets.to_numpy().astype(np.int64), runs.values.to_numpy()
            for lo, hi in pieces(offs):
                units, first = u.split(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                row = np.repeat(np.arange(hi - lo), np.diff(edge[lo:hi + 1]))
                own = flat[edge[lo]:edge[hi]]
                settled = (own & 1).astype(bool)
                hot = ~settled & ((own >> 1) & 1).astype(bool)
                start, size = own >> 10, (own >> 2) & 255
                yield from _settled(row[settled], start[settled], size[settled], keys[lo:hi], u, n)
                order = np.lexsort((start, row))
                alone = order[hot[order]]
                for a in range(0, len(alone), SLICE):
                    i = alone[a:a + SLICE]
                    yield from _send_windows(units, first, row[i], start[i], size[i], keys[lo:hi], ranks[lo:hi], u, n)
                order = order[~settled[order] & ~hot[order]]
                yield from _send(units, first, row[order], start[order], size[order], keys[lo:hi], ranks[lo:hi], u, n)

    return docs.mapInArrow(tidy(run), _ddl(_SENT))


def _settled(row: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray, u: Units,
             n: int) -> Iterator[pa.RecordBatch]:
    """Settled runs, spread over the shards by document."""
    if len(row):
        spread = (mix(keys[row].view(np.uint64)) >> np.uint64(32)) % np.uint64(n)
        yield _batch([{"kind": KNOWN, "units": b"", "anchor": b"", "rank": b""} | x for x in _packed(
            spread.astype(np.int64), n, {"key": keys[row], "at": start.astype(np.int32),
                                         "length": size.astype(np.int32)})], _SENT)


def _send(units: np.ndarray, first: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray,
          keys: np.ndarray, ranks: np.ndarray, u: Units, n: int) -> Iterator[pa.RecordBatch]:
    """Stretches of the runs that go on, packed by shard; repeated rows' runs only once."""
    begin, length = first[row] + start, size + u.window - 1
    if not len(begin):
        return
    # Anchors again, with the rule of anchor_runs, on the stretches alone.
    units = _concat(units, begin, length)
    edge = np.concatenate([[0], np.cumsum(length)])
    r, _, _, place, h, _ = anchor_runs(units, edge, u.window, u.gram)
    one = np.unique(r, return_index=True)[1]
    anchor = (place[one] - edge[r[one]]).astype(np.uint16)
    bucket = ((h[one] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    records = []
    for b in np.flatnonzero(np.diff(edges)):
        i = order[edges[b]:edges[b + 1]]
        records.append({"bucket": int(b), "kind": STRETCH} | {k: _planes(v) for k, v in (
            ("rank", ranks[row[i]]), ("key", keys[row[i]]), ("units", _concat(units, edge[i], length[i]).astype(u.dtype)),
            ("length", length[i].astype(np.uint16)), ("anchor", anchor[i]), ("at", start[i].astype(np.int32)))})
    yield _batch(records, _SENT)


def _send_windows(units: np.ndarray, first: np.ndarray, row: np.ndarray, start: np.ndarray, size: np.ndarray,
                  keys: np.ndarray, ranks: np.ndarray, u: Units, n: int) -> Iterator[pa.RecordBatch]:
    """The windows of runs, by row and start, each to a shard by its hash; what is settled here is known."""
    if not len(row):
        return
    length = size + u.window - 1
    units = _concat(units, first[row] + start, length)
    at = flat_ranges(np.cumsum(length) - length, size)
    row, start = np.repeat(row, size), flat_ranges(start, size)
    part = units.astype(np.uint64) + np.uint64(1)
    deal = gram_hashes(part, u.window)[at]
    name = mix(deal) ^ gram_hashes(mix(part), u.window)[at]
    none = np.zeros(len(name), np.uint64)
    gone, _ = _settle(none, name, ranks[row], keys[row], start, u)
    lost, live = np.flatnonzero(gone), np.flatnonzero(~gone)
    head, count = _in_a_row(row[lost], start[lost], none[lost])
    yield from _settled(row[lost[head]], start[lost[head]], count, keys, u, n)
    # Equal windows in a row, as in a text of one letter, stay together.
    head, count = _in_a_row(row[live], start[live], name[live])
    live = live[head]
    if len(live):
        bucket = ((deal[live] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        yield _batch([{"kind": WINDOWS, "anchor": b""} | x for x in _packed(bucket, n, {
            "units": name[live], "length": count.astype(np.int32), "rank": ranks[row[live]], "key": keys[row[live]],
            "at": start[live].astype(np.int32)})], _SENT)


def _in_a_row(row: np.ndarray, start: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first and number of windows of the same name that follow each other in a row."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1) | (name[1:] != name[:-1])
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(row)))


def _concat(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return values[flat_ranges(starts, lengths)]


def _solved(u: Units, solve: Callable[[Stretches, Units], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """A shard's runs of windows that start earlier elsewhere."""
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out = []
        known = table.filter(pa.array(kind == KNOWN))
        if known.num_rows:
            out.append((_joined(known, "key", "<i8"), _joined(known, "at", "<i4").astype(np.int64),
                        _joined(known, "length", "<i4").astype(np.int64)))
        alone = table.filter(pa.array(kind == WINDOWS))
        if alone.num_rows:
            name, rank, key, at, n = (_joined(alone, *x) for x in (
                ("units", "<u8"), ("rank", "<i8"), ("key", "<i8"), ("at", "<i4"), ("length", "<i4")))
            gone, _ = _settle(np.zeros(len(name), np.uint64), name, rank, key, at, u)
            out.append((key[gone], at[gone].astype(np.int64), n[gone].astype(np.int64)))
        own = table.filter(pa.array(kind == STRETCH))
        if own.num_rows:
            out.append(_later(u, solve, *[_joined(own, *x).astype(x[1] if x[0] == "units" else np.int64) for x in (
                ("units", u.dtype), ("length", "<u2"), ("anchor", "<u2"), ("rank", "<i8"), ("key", "<i8"), ("at", "<i4"))]))
        key, start, n = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(key), pa.array(start), pa.array(n)], schema=_RUNS)

    return run


def _later(u: Units, solve: Callable[[Stretches, Units], np.ndarray], units: np.ndarray, length: np.ndarray,
           anchor: np.ndarray, rank: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, start and number of windows of the runs that start earlier elsewhere."""
    starts = np.cumsum(length) - length
    whole = hash_spans(units.view(np.uint8), starts * units.itemsize, (starts + length) * units.itemsize)
    order = np.lexsort((at, key, rank, whole))
    new = np.concatenate([[True], whole[order[1:]] != whole[order[:-1]]])
    head = order[new]
    member = np.empty(len(order), np.int64)
    member[order] = np.cumsum(new) - 1
    place = np.lexsort((at[head], key[head], rank[head]))
    head = head[place]
    turn = np.empty(len(place), np.int64)
    turn[place] = np.arange(len(place))
    member = turn[member]
    head_length = length[head]
    s = Stretches(_concat(units, starts[head], head_length), np.cumsum(head_length) - head_length, head_length,
                  anchor[head], np.bincount(member, minlength=len(head)))
    first = solve(s, u)
    n = length - u.window + 1
    window = _concat(first, s.starts[member], n)
    owner = np.searchsorted(s.starts, window, side="right") - 1
    which = np.repeat(np.arange(len(length)), n)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
    gone = rank[which] > rank[head[owner]]
    if u.within:
        gone |= (key[which] != key[head[owner]]) | (at[which] + offset != at[head[owner]] + window - s.starts[owner])
    edge = gone.copy()
    edge[1:] &= ~(gone[:-1] & (which[1:] == which[:-1]))
    begin = np.flatnonzero(edge)
    run = np.cumsum(edge)[gone]
    return key[which[begin]], at[which[begin]] + offset[begin], np.bincount(run, minlength=len(begin) + 1)[1:]


def earlier_windows(docs: DataFrame, id_col: str, text_col: str, u: Units,
                    solve: Callable[[Stretches, Units], np.ndarray], bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, text, gone, whole) for every row of ``docs``.

    ``gone`` holds runs of windows (start, n) that start earlier elsewhere, in units; ``whole`` is
    true for a document whose text a document with a smaller id has, too: all its windows are gone.
    Ids are integers; a null id counts as larger than all others. Rows that repeat id and text get
    the same answer; rows that share an id but not the text are different documents of equal rank.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(rank, text).alias("key"), text.alias("text"))
    narrow = docs.select(F.xxhash64(rank, text).alias("key"), rank.alias("rank"), F.md5(text).alias("digest"))
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n = buckets_for(total, bucket_bytes)
    # Equal texts with equal ids have equal keys, so what is no head has a smaller id before it.
    heads = narrow.groupBy("digest").agg(F.min(F.struct("rank", "key")).alias("first")) \
        .select(F.col("first.key").alias("key"), F.lit(True).alias("head"))
    ranked = F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("rank")
    # All three joins need the same columns of ``rows``, so its one shuffle serves them all.
    runs = _anchors(rows.join(heads, "key").select("key", "id", ranked, "text"), u, buckets_for(total, 4 * bucket_bytes)) \
        .groupBy("bucket").applyInArrow(tidy(_repeating(u)), _ddl(_FOUND)) \
        .groupBy("key").agg(F.collect_set("run").alias("runs"))
    sent = _stretches(rows.join(runs, "key").select("key", ranked, "text", "runs"), u, n)
    verdicts = sent.groupBy("bucket").applyInArrow(tidy(_solved(u, solve)), _ddl(_RUNS)) \
        .groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    return rows.join(heads.join(verdicts, "key", "left"), "key", "left") \
        .select("id", "text", "gone", F.col("head").isNull().alias("whole"))
