"""Substring dedup by fixed-block anchors.

Each document's words are cut into blocks of `block` words that don't overlap;
with 2 * block - 1 <= window, any shared run of `window` words holds a whole
block of either document. Every rolling `block`-word window of every document
probes the blocks (both meet by hash in one exchange). Around each hit the match
is extended: the `window`-word windows that hold the anchor are compared, by
64-bit hashes, in a second exchange that finds the smallest document id of each.
Adjacent windows make up the maximal repeats.

Before each exchange a task settles what it can among its own documents and
sends one entry in place of its copies, so that a passage with any number of
copies costs an entry per task. Texts go twice to the partition of their
document, compressed, together with the places found there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange as ex
from . import _text as tx
from ._spark import in_tasks

RESULT = "doc_id long, n_words long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_text string, kept_sha256 string"
ANCHORS, WINDOWS = ex.PLACES, ex.PLACES + 10


def _probe(window: int, block: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            out = ex.Outbox(parts)
            for batch in tx.chunks(batches):
                words = tx.split(batch.column(1), tx.BLANK_SEPARATED)
                h = tx.windows(words.hashes(), block)
                doc = words.doc[: len(h)]
                at = np.flatnonzero(words.inside(block) & (words.counts >= window)[doc])
                if not len(at):
                    continue
                h, doc = h[at], doc[at]
                place = at - words.first[doc]
                ids = batch.column(0).to_numpy()[doc]
                o = tx.order(h)
                first, group = tx.groups(h[o])
                last = np.append(first[1:], len(o)) - 1
                block_at = np.where(place[o] % block == 0, np.arange(len(o)), len(o))
                anchor = np.minimum.reduceat(block_at, first) if len(first) else first
                here = (ids[o][first] != ids[o][last]) & (anchor < len(o))  # settled: in several documents of this chunk, and a block in one
                settled = np.zeros(len(o), bool)
                settled[o] = here[group]
                send = ~settled
                send[o[anchor[here]]] = True
                yield from out.put(ex.ENTRIES, ex.hash_part(h[send], parts), ids[send], place[send], [h[send].astype(np.uint32)])
                yield from out.put(ANCHORS, ex.id_part(ids[settled], parts), ids[settled], place[settled])
            yield from out.rest()

        yield from ex.record_batches(messages())

    return run


def _through(rows: Iterator[tuple[int, int, bytes]], entries: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    for row in rows:
        if row[1] == ex.ENTRIES:
            entries.append(row[2])
        else:
            yield row


def _match_anchors(block: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            entries: list[bytes] = []
            yield from _through(ex.read(batches), entries)
            if not entries:
                return
            ids, place, h = ex.unpack(entries)
            o = tx.order(h.astype(np.uint64) << np.uint64(32))
            first, group = tx.groups(h[o])
            many = np.minimum.reduceat(ids[o], first) != np.maximum.reduceat(ids[o], first)
            hit = many & np.logical_or.reduceat(place[o] % block == 0, first)
            found = np.sort(o[hit[group]])
            yield from ex.pack(parts, ANCHORS, ex.id_part(ids[found], parts), ids[found], place[found])

        yield from ex.record_batches(messages())

    return run


def _extend(window: int, block: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            inbox, out = ex.Inbox(batches), ex.Outbox(parts)
            for batch in inbox.chunks():
                found = inbox.places(ANCHORS, batch.column(0).to_numpy())
                batch = batch.filter(pa.array([len(x) > 0 for x in found]))
                found = [x for x in found if len(x)]
                if not found:
                    continue
                words = tx.split(batch.column(1), tx.BLANK_SEPARATED)
                anchors = np.concatenate([x + a for x, a in zip(found, words.first[:-1], strict=True)])
                n = max(0, len(words.starts) - window + 1)
                start = np.maximum(anchors - (window - block), 0)
                edge = np.zeros(len(words.starts) + 2, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, anchors + 1, -1)
                at = np.flatnonzero((np.cumsum(edge)[:n] > 0) & words.inside(window))
                h = tx.windows(words.hashes(), window)[at]
                doc = words.doc[at]
                place, ids = at - words.first[doc], batch.column(0).to_numpy()[doc]
                o = tx.order(h)
                first, group = tx.groups(h[o])
                if not len(first):
                    continue
                repeat = np.zeros(len(o), bool)
                repeat[o] = ids[o] > np.minimum.reduceat(ids[o], first)[group]
                yield from out.put(ex.ENTRIES, ex.hash_part(h[~repeat], parts), ids[~repeat], place[~repeat], [h[~repeat]])
                yield from out.put(WINDOWS, ex.id_part(ids[repeat], parts), ids[repeat], place[repeat])
            yield from out.rest()

        yield from ex.record_batches(messages())

    return run


def _match_windows(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            entries: list[bytes] = []
            yield from _through(ex.read(batches), entries)
            if not entries:
                return
            ids, place, h = ex.unpack(entries)
            o = tx.order(h)
            first, group = tx.groups(h[o])
            found = np.sort(o[ids[o] > np.minimum.reduceat(ids[o], first)[group]])
            yield from ex.pack(parts, WINDOWS, ex.id_part(ids[found], parts), ids[found], place[found])

        yield from ex.record_batches(messages())

    return run


def _cut(window: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inbox = ex.Inbox(batches)
        for batch in inbox.chunks():
            rows = []
            for doc_id, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), inbox.places(WINDOWS, batch.column(0).to_numpy()), strict=True):
                words = (text or "").encode().split()
                spans, kept = [], words
                if len(places):
                    gone = tx.covered(places, window, len(words))
                    spans = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in tx.runs(gone)), strict=True)]
                    kept = list(compress(words, ~gone))
                out = b" ".join(kept)
                rows.append((None if doc_id == ex.NULL_ID else doc_id, len(words), len(words) - len(kept), len(spans), spans, out.decode() if with_text else None, hashlib.sha256(out).hexdigest()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string()], strict=True)], ["doc_id", "n_words", "n_removed", "n_spans", "spans", "kept_text", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text; others are ignored): words that stand in a window of `window` words that a document of a smaller id has too are removed.

    Returns doc_id, n_words, n_removed, n_spans, spans (word ranges removed),
    kept_text (null unless with_text) and kept_sha256. Windows are judged on the
    input. Null and empty texts have no words. A null doc_id counts as larger than all. Rows that
    share an id count as one document and should have the same text: none is smaller than the other.
    """
    block = (window + 1) // 2
    parts = ex.parts_of(docs)
    texts = ex.texts(docs)
    sent = texts.mapInArrow(in_tasks(ex.send_texts(parts)), ex.SCHEMA)
    anchors = ex.exchange(parts, _match_anchors(block, parts), ex.SCHEMA, texts.mapInArrow(in_tasks(_probe(window, block, parts)), ex.SCHEMA))
    extended = ex.exchange(parts, _extend(window, block, parts), ex.SCHEMA, anchors, sent)
    windows = ex.exchange(parts, _match_windows(parts), ex.SCHEMA, extended)
    return ex.exchange(parts, _cut(window, with_text), RESULT, windows, sent)
