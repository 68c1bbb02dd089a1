"""Suffix-array dedup of byte strings of `length` bytes or more, across documents.

1. Anchors. Of every `spread` consecutive places the one with the least 8-gram
   hash is an anchor, so each string of `length` bytes holds an anchor near its
   start, and equal strings hold it at the same place. Anchors whose next
   `length - spread + 1` bytes occur once in the table are out: no repeat begins
   before them. Anchors whose whole surroundings (every string that this anchor
   stands for) are equal elsewhere are settled. The rest, where repeats begin or
   end, go on, one anchor for each different surrounding.
2. Suffix arrays. Documents are in shards by id. Each shard sorts the suffixes of
   what went on (Larsson-Sadakane: prefix doubling that touches only groups not
   yet in order), gets common prefixes by Kasai's method, and so has classes of
   equal strings. A class settles its members within the shard.
3. Merging. One entry for each class goes, under a 64-bit hash of its string, to
   a range of hashes; the sorted runs of the shards are merged by binary search,
   and strings found in several runs are repeats.

No step pairs up occurrences: a string with any number of copies costs an entry
per task and exchange.

Step 1 also tells of shorter repeats, which nothing removes: an anchor is shared
when its next `shortest - spread + 1` bytes stand elsewhere too. A document that
holds a string of `shortest` bytes that starts elsewhere has a shared anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange as ex
from . import _text as tx
from ._spark import in_tasks

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string, n_shared long"
#: Kinds of places: anchors whose surroundings repeat, anchors that go on, starts of repeats, other shared anchors.
SETTLED, OPEN, STARTS, NEAR = ex.PLACES + 20, ex.PLACES + 30, ex.PLACES + 40, ex.PLACES + 45
SHARD_BYTES = 2 << 20


def spread_of(length: int) -> int:
    return max(1, length // 6)


def _loads(data: np.ndarray) -> np.ndarray:
    """At each place the 8 bytes from there on as a number; data ends with 8 bytes of padding or more."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of t in the order of their suffixes (a suffix that ends first is smaller)."""
    n = len(t)
    padded = np.concatenate((t, np.zeros(8, np.uint8)))
    key = _loads(padded)[:n].byteswap().astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    first, group = tx.groups(key[sa])
    short = np.arange(max(0, n - 8), n)  # these suffixes are shorter than their keys: the padding must come first
    if len(short):
        sizes = np.diff(np.append(first, n))
        for g in np.unique(group[np.isin(sa, short)]):
            a, b = first[g], first[g] + sizes[g]
            part = sa[a:b]
            sa[a:b] = part[np.argsort(np.where(part >= n - 8, n - part, 9), kind="stable")]
    k = key[sa]
    width = np.minimum(n - sa, 8)
    new = np.ones(n, bool)
    new[1:] = (k[1:] != k[:-1]) | (width[1:] != width[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = start + 1, 0
    single = new & np.append(new[1:], True)
    slots, h = np.flatnonzero(~single), 8
    while len(slots):
        own = sa[slots]
        pair = (rank[own].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(own + h, n)].astype(np.uint64)
        o = np.argsort(pair, kind="stable")
        own, pair = own[o], pair[o]
        sa[slots] = own
        new = np.ones(len(slots), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[own] = np.maximum.accumulate(np.where(new, slots, 0)) + 1
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int, lane: int = 256) -> np.ndarray:
    """At each place of sa the bytes (cap at most) that its suffix shares with the one before: Kasai's method, run over many stretches of t at once."""
    n = len(t)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    padded = _loads(np.concatenate((t, np.zeros(cap + 16, np.uint8))))
    before = np.empty(n, np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    i = np.arange(0, n, lane)
    end = np.minimum(i + lane, n)
    have = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        x = padded[i + have] ^ padded[np.maximum(j, 0) + have]
        same = np.zeros(len(i), np.int64)
        for k in range(1, 9):
            same += (x & np.uint64((1 << (8 * k)) - 1)) == 0
        have += same
        stop = np.minimum(cap, n - np.maximum(i, j))
        over = (same < 8) | (have >= stop)
        have = np.where(j < 0, 0, np.minimum(have, stop))
        over |= j < 0
        out[i[over]] = have[over]
        i = i + over
        have = np.where(over, np.maximum(have - 1, 0), have)
        keep = i < end
        if not keep.all():
            i, end, have = i[keep], end[keep], have[keep]
    return out[sa]


def _anchors(length: int, shortest: int, parts: int) -> Callable:
    spread = spread_of(length)
    span, near_span = length - spread + 1, shortest - spread + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            out = ex.Outbox(parts)
            for batch in tx.chunks(batches):
                data, starts = tx.joined(batch.column(1))
                ends = starts[1:] - 1
                grams = tx.mix(_loads(np.concatenate((data, np.zeros(8, np.uint8))))[: len(data)].astype(np.uint64))
                at = tx.minima(grams, spread)
                del grams
                doc = np.searchsorted(starts, at, "right") - 1
                ok = at + near_span <= ends[doc]
                at, doc = at[ok], doc[ok]
                if not len(at):
                    continue
                left, right = np.maximum(at - spread + 1, starts[doc]), np.minimum(at + length, ends[doc])
                around = tx.mix(tx.span_hashes(data, left, right) + (at - left).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                near = tx.span_hashes(data, at, at + near_span)
                whole = at + span <= ends[doc]
                core = np.zeros(len(at), np.uint32)
                core[whole] = tx.span_hashes(data, at[whole], at[whole] + span).astype(np.uint32)
                ids, place = batch.column(0).to_numpy()[doc], at - starts[doc]
                o = np.lexsort((around, near))
                first, group = tx.groups(tx.mix(near[o]) ^ around[o])
                many = np.diff(np.append(first, len(o))) > 1
                twin = np.empty(len(o), bool)
                twin[o] = many[group]
                send = np.zeros(len(o), bool)
                send[o[first]] = True
                marks = (around << np.uint64(2)) | (whole.astype(np.uint64) << np.uint64(1)) | twin.astype(np.uint64)
                yield from out.put(ex.ENTRIES, ex.hash_part(near[send], parts), ids[send], place[send], [near[send], core[send], marks[send]])
                for kind, m in ((SETTLED, twin & whole), (NEAR, twin & ~whole)):
                    yield from out.put(kind, ex.id_part(ids[m], parts), ids[m], place[m])
            yield from out.rest()

        yield from ex.record_batches(messages())

    return run


def _entries(batches: Iterator[pa.RecordBatch], bodies: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    for row in ex.read(batches):
        if row[1] == ex.ENTRIES:
            bodies.append(row[2])
        else:
            yield row


def _compare_anchors(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            bodies: list[bytes] = []
            yield from _entries(batches, bodies)
            if not bodies:
                return
            ids, place, near, core, marks = ex.unpack(bodies)
            o = tx.order(near)
            first, group = tx.groups(near[o])
            met = (np.diff(np.append(first, len(o))) > 1) | np.logical_or.reduceat((marks[o] & np.uint64(1)) == 1, first)
            shared = np.zeros(len(o), bool)
            shared[o] = met[group]
            del near, o, group
            # only what is shared can be a longer repeat
            among = np.flatnonzero(shared & ((marks & np.uint64(2)) != 0))
            if len(among):
                around = marks[among] >> np.uint64(2)
                o = among[np.lexsort((around, core[among]))]
                around = marks[o] >> np.uint64(2)
                outer, outer_group = tx.groups(core[o])
                inner, inner_group = tx.groups((core[o].astype(np.uint64) << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) ^ around)
                several = np.diff(np.append(inner, len(o))) > 1
                twin = np.logical_or.reduceat((marks[o] & np.uint64(1)) == 1, inner)
                kinds = np.bincount(outer_group[inner])
                alone = np.logical_or.reduceat(~(several | twin), np.searchsorted(inner, outer))
                go_on = (kinds > 1) & alone
                settled = np.sort(o[several[inner_group]])
                open_ = np.sort(o[inner[go_on[outer_group[inner]]]])
                shared[settled] = False
                yield from ex.pack(parts, SETTLED, ex.id_part(ids[settled], parts), ids[settled], place[settled])
                yield from ex.pack(parts, OPEN, ex.id_part(ids[open_], parts), ids[open_], place[open_])
            yield from ex.pack(parts, NEAR, ex.id_part(ids[shared], parts), ids[shared], place[shared])

        yield from ex.record_batches(messages())

    return run


def repeats_in_shard(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in classes of two or more, one place of each class or of none) among starts, for equal strings of length bytes of data.

    data is cut to the regions that the strings cover, with byte 0xFF, which
    UTF-8 never has, between them.
    """
    mask = tx.covered(starts, length, len(data))
    a, b = tx.runs(mask)
    sizes = b - a + 1
    begin = np.cumsum(sizes) - sizes
    shift = np.repeat(a - begin, sizes)
    source = np.arange(len(shift)) + shift
    edge = begin + sizes - 1
    t = data[np.minimum(source, len(data) - 1)]
    t[edge] = 0xFF
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    local = wanted[np.minimum(source, len(data) - 1)]
    local[edge] = False
    sa = suffix_array(t)
    equal = common_prefixes(t, sa, length) >= length
    group = np.cumsum(~equal) - 1
    is_start = local[sa]
    n = np.bincount(group)
    inside = (np.repeat(edge, sizes) - np.arange(len(t)))[sa] >= length
    several = (n[group] > 1) & inside
    chosen = np.flatnonzero(is_start)
    _, one = np.unique(group[chosen], return_index=True)
    return np.sort(source[sa[several & is_start]]), np.sort(source[sa[chosen[one]]])


def _shard(length: int, parts: int) -> Callable:
    spread = spread_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            inbox, out = ex.Inbox(batches), ex.Outbox(parts)
            for kind, (ids, first, place) in inbox.found.items():
                if kind != OPEN:
                    doc = np.repeat(ids, np.diff(first))
                    yield from ex.pack(parts, kind, ex.id_part(doc, parts), doc, place)
            for batch in inbox.chunks():
                found = inbox.places(OPEN, batch.column(0).to_numpy())
                batch = batch.filter(pa.array([len(x) > 0 for x in found]))
                found = [x for x in found if len(x)]
                for piece in tx.chunks(iter([batch]), limit=SHARD_BYTES) if found else []:
                    own, found = found[: piece.num_rows], found[piece.num_rows :]
                    data, begin = tx.joined(piece.column(1))
                    wanted = np.zeros(len(data) + 1, np.int32)
                    for x, a, b in zip(own, begin[:-1], begin[1:] - 1, strict=True):
                        x = x + a
                        low, high = np.maximum(x - spread + 1, a), np.minimum(x, b - length) + 1
                        ok = low < high
                        np.add.at(wanted, low[ok], 1)
                        np.add.at(wanted, high[ok], -1)
                    at = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                    if not len(at):
                        continue
                    several, one = repeats_in_shard(data, at, length)
                    ids = piece.column(0).to_numpy()
                    doc = np.searchsorted(begin, several, "right") - 1
                    yield from out.put(STARTS, ex.id_part(ids[doc], parts), ids[doc], several - begin[doc])
                    h = tx.span_hashes(data, one, one + length)
                    doc = np.searchsorted(begin, one, "right") - 1
                    yield from out.put(ex.ENTRIES, ex.hash_part(h, parts), ids[doc], one - begin[doc], [h])
            yield from out.rest()

        yield from ex.record_batches(messages())

    return run


def merged(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted runs (key, values ...) as one, two at a time, the places of the smaller run's keys by binary search."""
    while len(runs) > 1:
        out = []
        for a, b in zip(runs[::2], runs[1::2], strict=False):
            if len(a[0]) < len(b[0]):
                a, b = b, a
            at = np.searchsorted(a[0], b[0]) + np.arange(len(b[0]))
            own = np.ones(len(a[0]) + len(b[0]), bool)
            own[at] = False
            both = []
            for x, y in zip(a, b, strict=True):
                z = np.empty(len(own), x.dtype)
                z[own], z[at] = x, y
                both.append(z)
            out.append(tuple(both))
        runs = out + (runs[-1:] if len(runs) % 2 else [])
    return runs[0]


def _merge(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            bodies: list[bytes] = []
            yield from _entries(batches, bodies)
            runs = []
            for body in bodies:
                ids, place, h = ex.unpack([body])
                o = np.argsort(h, kind="stable")
                runs.append((h[o], ids[o], place[o]))
            if not runs:
                return
            h, ids, place = merged(runs)
            first, group = tx.groups(h)
            found = np.flatnonzero((np.diff(np.append(first, len(h))) > 1)[group])
            found = found[np.lexsort((place[found], ids[found]))]
            yield from ex.pack(parts, STARTS, ex.id_part(ids[found], parts), ids[found], place[found])

        yield from ex.record_batches(messages())

    return run


def _cut(length: int, with_text: bool) -> Callable:
    spread = spread_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inbox = ex.Inbox(batches)
        for batch in inbox.chunks():
            rows = []
            places = [inbox.places(kind, batch.column(0).to_numpy()) for kind in (SETTLED, STARTS, NEAR)]
            for doc_id, text, anchors, starts, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *places, strict=True):
                raw = (text or "").encode()
                shared = len(np.union1d(anchors, near)) if len(anchors) and len(near) else len(anchors) + len(near)
                spans, kept = [], raw
                if len(anchors) or len(starts):
                    low, high = np.maximum(anchors - spread + 1, 0), np.minimum(anchors, len(raw) - length)
                    ok = low <= high
                    edge = np.zeros(len(raw) + 1, np.int32)
                    for a, b in ((low[ok], high[ok] + length), (starts, starts + length)):
                        np.add.at(edge, a, 1)
                        np.add.at(edge, b, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in tx.runs(gone)), strict=True)]
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((None if doc_id == ex.NULL_ID else doc_id, len(raw), len(raw) - len(kept), len(spans), spans, kept if with_text else None, hashlib.sha256(kept).hexdigest(), shared))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string(), pa.int64()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256", "n_shared"])

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 400, with_text: bool = True, shortest: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text; others are ignored): bytes covered by a string of length bytes (48 or more make sense) that also starts elsewhere in the table are removed.

    Returns doc_id, n_bytes, n_removed, n_spans, spans (byte ranges removed),
    kept (null unless with_text), kept_sha256 and n_shared. Every occurrence goes, the first too; matches
    never cross documents, and strings are judged on the input. Null and empty texts have no bytes.
    n_shared counts anchors whose next bytes stand elsewhere too: at least 1 if the document holds a string
    of `shortest` bytes (16/25 of length unless given) that also starts elsewhere, 0 if it holds none of `shortest` - length // 6 + 1.
    Rows that repeat an id and text are occurrences of their own; rows that share an id should have the same text.
    """
    parts = ex.parts_of(docs)
    texts = ex.texts(docs)
    shortest = min(length, max(shortest or length * 16 // 25, spread_of(length) + 8))
    sent = texts.mapInArrow(in_tasks(ex.send_texts(parts)), ex.SCHEMA)
    anchors = ex.exchange(parts, _compare_anchors(parts), ex.SCHEMA, texts.mapInArrow(in_tasks(_anchors(length, shortest, parts)), ex.SCHEMA))
    shards = ex.exchange(parts, _shard(length, parts), ex.SCHEMA, anchors, sent)
    starts = ex.exchange(parts, _merge(parts), ex.SCHEMA, shards)
    return ex.exchange(parts, _cut(length, with_text), RESULT, starts, sent)
