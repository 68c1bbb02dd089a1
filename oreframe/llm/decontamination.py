"""Benchmark decontamination by winnowing.

Of every sliding window of W k-gram hashes the minimum is kept as a
fingerprint. With W + k - 1 = window, two texts that share `window` consecutive
words share a fingerprint at the same place of that span. Documents probe the
benchmark's fingerprints; around each hit every `window`-word window is compared
with the benchmark's windows, so that the result is exact.

The benchmark goes to the tasks in blocks of about `block_bytes` of text (one
block unless it is larger), each block against all documents; documents are not
shuffled for one block. For several they are checkpointed with a number for each
row, by which the blocks' results are combined; a block's result is written before the
next block is sent, so that driver and tasks hold one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import checkpointed, in_tasks

BLOCK_BYTES = 32 << 20
GRAM = 6

SCHEMA = "row long, doc_id long, n_words long, hits binary, items array<long>"


class Index:
    """Windows and fingerprints of a block of the benchmark."""

    def __init__(self, rows: list[tuple[int, str | None]], window: int):
        self.window, self.gram = window, min(GRAM, window)
        words = tx.split(pa.array([t for _, t in rows], pa.string()), tx.ALPHANUMERIC, lower=True)
        h = words.hashes()
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        prints = []
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            if a == b or rows[i][0] is None:
                continue
            size = min(window, b - a)
            w = tx.windows(h[a:b], size)
            parts.setdefault(int(size), []).append((w, np.full(len(w), rows[i][0], np.int64)))
            if size == window:
                grams = tx.windows(h[a:b], self.gram)
                prints.append(grams[tx.minima(grams, window - self.gram + 1)])
        for size, found in parts.items():
            w, item = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            at = np.lexsort((item, w))
            self.sizes[size] = w[at], item[at]
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)

    def probe(self, words: tx.Words) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """(places, width, first, last): a window of width words at each place is that of entries first:last."""
        h = words.hashes()
        for size, (w, _) in self.sizes.items():
            own = tx.windows(h, size)
            inside = words.inside(size)
            if size == self.window:
                grams = tx.windows(h, self.gram)
                at = tx.minima(grams, self.window - self.gram + 1)
                at = at[_in(grams[at], self.prints)]
                near = np.zeros(len(own) + 1, bool)
                for back in range(self.window - self.gram + 1):
                    near[np.clip(at - back, 0, len(own))] = True
                at = np.flatnonzero(near[: len(own)] & inside)
            else:
                at = np.flatnonzero(inside)
            first = np.searchsorted(w, own[at], "left")
            last = np.searchsorted(w, own[at], "right")
            ok = last > first
            yield at[ok], size, first[ok], last[ok]


def _in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.searchsorted(among, x)
    return among[np.minimum(at, len(among) - 1)] == x


def _search(index) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in tx.chunks(batches):
            words = tx.split(batch.column(2), tx.ALPHANUMERIC, lower=True)
            n, doc = len(words.starts), words.doc
            hit = np.zeros(n, bool)
            pairs = []
            for at, size, first, last in known.probe(words):
                hit |= tx.covered(at, size, n)
                if len(at):  # a window counts once for a document, however often it stands there
                    _, one = np.unique(doc[at] * np.int64(len(known.sizes[size][0]) + 1) + first, return_index=True)
                    count = last[one] - first[one]
                    entry = np.repeat(first[one] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    pairs.append((np.repeat(doc[at[one]], count), known.sizes[size][1][entry]))
            own = np.concatenate([d for d, _ in pairs]) if pairs else np.empty(0, np.int64)
            item = np.concatenate([i for _, i in pairs]) if pairs else np.empty(0, np.int64)
            o = np.lexsort((item, own))
            own, item = own[o], item[o]
            keep = np.ones(len(own), bool)
            keep[1:] = (own[1:] != own[:-1]) | (item[1:] != item[:-1])
            own, item = own[keep], item[keep]
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(item, pa.int64()))
            hits = [np.flatnonzero(hit[a:b]).astype("<i8").tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(words.counts, pa.int64()), pa.array(hits, pa.binary()), found], ["row", "doc_id", "n_words", "hits", "items"])

    return run


def _report(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = batch.column(1).to_numpy()
            n_hit, n_items, digest = [], [], []
            for hits, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n_hit.append(len(np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in hits]))) if any(hits) else 0)
                ids = sorted({str(x) for x in items})
                n_items.append(len(ids))
                digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
            n_hit = np.array(n_hit, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n_hit), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array((n_hit > 0) & (share * n_hit >= n_words))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def _search_and_report(index, share: int):
    search, report = _search(index), _report(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in search(batches):
            one = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1), pa.int32()), b.column(3))
            yield from report(iter([pa.record_batch([b.column(1), b.column(2), one, b.column(4)], ["doc_id", "n_words", "hits", "items"])]))

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs needs doc_id and text, benchmark item_id and text; other columns are
    ignored. Rows that share an id, or have none, have results of their own. Null and empty texts have no words and are never contaminated;
    benchmark items without words, or with a null id, match nothing; rows that share an
    item_id are one item; an empty benchmark leaves every document clean. An item of fewer than window words is
    one window. A document is contaminated when share * n_hit >= n_words > 0 and n_hit > 0.
    """
    spark, result = docs.sparkSession, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    documents = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents = documents if blocks == 1 else checkpointed(documents)  # so that each block sees the same row numbers
    found = None
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in block.toLocalIterator()], window))
        if blocks == 1:
            return documents.mapInArrow(in_tasks(_search_and_report(index, share)), result)
        part = checkpointed(documents.mapInArrow(in_tasks(_search(index)), SCHEMA))
        index.unpersist()  # one block's index is held at a time
        found = part if found is None else found.unionByName(part.where("octet_length(hits) > 0"))  # the first block's rows tell of all documents
    found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.flatten(F.collect_list("items")).alias("items")).drop("row")
    return found.mapInArrow(in_tasks(_report(share)), result)
