"""Ranked lexical search of all documents for a batch of items, by hashed max-sketches.

A term's impact on a document is what it adds to a score. The impacts of a document
are folded into a few hundred coordinates, each the largest impact of the terms
hashed to it. Looking an item's terms up there, for all items and documents of
a block at once, gives a bound that no score exceeds. Documents are scored exactly in
descending order of their bounds, until no bound reaches the item's k-th best score.

Documents are never shuffled. A first scan counts documents, words and document
frequencies of the items' terms; a second one searches, each task keeping k rows an
item, which are merged in two levels. Items go to the tasks in blocks of at most
`block_bytes` of terms, one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import checkpointed, in_tasks

#: Coordinates of a sketch, documents and items bounded together, documents scored between two looks at the bounds.
COORDINATES, DOCUMENTS, ITEMS, STEP = 1024, 2048, 256, 32
#: Bytes of an item block: 16 for each distinct term of an item.
BLOCK_BYTES = 8 << 20
NULL_ID = np.iinfo(np.int64).max


class Block:
    """Items as distinct terms with their counts; term i of the vocabulary is terms[i]."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]]):
        self.rows = np.array([r for r, _, _ in rows], np.int64)
        self.first = np.concatenate(([0], np.cumsum([len(t) for _, t, _ in rows]))).astype(np.int64)
        self.terms, at = np.unique(np.concatenate([t for _, t, _ in rows]), return_inverse=True)
        self.at, self.times = at.astype(np.int64), np.concatenate([x for _, _, x in rows])
        self.slot = (tx.mix(self.terms) % np.uint64(COORDINATES)).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.terms >> np.uint64(44)] = True
        self.weight = np.zeros(len(self.terms), np.int64)
        self.documents = self.words = 0

    def weigh(self, documents: int, words: int, df: np.ndarray) -> Block:
        self.documents, self.words = documents, words
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        return self

    def counts(self, words: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, occurrences) of the vocabulary's terms in the documents of a chunk, ascending."""
        h = words.hashes()
        among = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.terms, h[among]), len(self.terms) - 1)
        ok = self.terms[at] == h[among]
        key, times = np.unique(words.doc[among[ok]] * len(self.terms) + at[ok], return_counts=True)
        return key // len(self.terms), key % len(self.terms), times


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.chunks(batches):
        words = tx.split(batch.column(2), tx.ALPHANUMERIC, lower=True)
        h, terms, times = words.hashes(), [], []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            t, c = np.unique(h[a:b], return_counts=True)
            terms.append(t.view(np.int64))
            times.append(c)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], ["row", "item_id", "terms", "times"])


def _count(block) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Block = block.value
        df, documents, n = np.zeros(len(known.terms), np.int64), 0, 0
        for batch in tx.chunks(batches):
            words = tx.split(batch.column(1), tx.ALPHANUMERIC, lower=True)
            documents, n = documents + int((words.counts > 0).sum()), n + len(words.starts)
            df += np.bincount(known.counts(words)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(df[some], documents)), pa.array(np.append(0 * some, n))], ["term", "df", "n"])

    return run


class _Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.score, self.doc = k, np.zeros((items, k), np.int64), np.full((items, k), NULL_ID)

    def least(self, items: slice | np.ndarray) -> np.ndarray:
        """What a score must reach to count."""
        return np.maximum(self.score[items, -1], 1)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        some, at = np.unique(item, return_inverse=True)
        owner = np.concatenate((np.repeat(np.arange(len(some)), self.k), at))
        doc, score = np.concatenate((self.doc[some].ravel(), doc)), np.concatenate((self.score[some].ravel(), score))
        o = np.lexsort((doc, -score, owner))
        first, group = tx.groups(owner[o])
        o = o[np.arange(len(o)) - first[group] < self.k]
        self.score[some], self.doc[some] = score[o].reshape(-1, self.k), doc[o].reshape(-1, self.k)


def _bounds(known: Block, sketch: np.ndarray, items: range) -> np.ndarray:
    """Of each item the greatest score that each document could have. Sketches hold integers under 2 ** 53 and are summed as doubles, so a bound is exact but for huge sums, for which scores are compared with a margin."""
    look_up = np.zeros((len(items), COORDINATES))
    a, b = known.first[items.start], known.first[items.stop]
    np.add.at(look_up, (np.repeat(np.arange(len(items)), np.diff(known.first[items.start : items.stop + 1])), known.slot[known.at[a:b]]), known.times[a:b])
    return look_up @ sketch


def _exact(known: Block, key: np.ndarray, impact: np.ndarray, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Score of each (item, document); key (document x vocabulary + term) ascends."""
    n = known.first[item + 1] - known.first[item]
    pair = np.repeat(np.arange(len(item)), n)
    entry = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(known.first[item], n)
    want = doc[pair] * len(known.terms) + known.at[entry]
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    found = key[at] == want
    out = np.zeros(len(item), np.int64)
    np.add.at(out, pair[found], known.times[entry[found]] * impact[at[found]])
    return out


def search_block(known: Block, best: _Best, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
    """Adds what the documents 0 .. len(ids) - 1 have to the best rows; entries (doc, term, impact) ascend."""
    if not len(doc):
        return
    sketch = np.zeros((COORDINATES, len(ids)))
    np.maximum.at(sketch, (known.slot[term], doc), impact)
    key = doc * len(known.terms) + term
    for start in range(0, len(known.rows), ITEMS):
        items = range(start, min(start + ITEMS, len(known.rows)))
        bound = _bounds(known, sketch, items)
        live = np.arange(len(items))
        while True:
            live = live[bound[live].max(1) >= best.least(live + start) * (1 - 1e-9)]
            if not len(live):
                break
            rows = bound[live]
            step = min(STEP, len(ids))
            top = np.argpartition(rows, len(ids) - step, axis=1)[:, len(ids) - step :]
            own, pick = np.repeat(live, step), top.ravel()
            ok = bound[own, pick] >= best.least(own + start) * (1 - 1e-9)
            own, pick = own[ok], pick[ok]
            bound[own, pick] = -1
            score = _exact(known, key, impact, own + start, pick)
            best.add((own + start)[score > 0], ids[pick[score > 0]], score[score > 0])


def _search(block, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Block = block.value
        best = _Best(len(known.rows), k)
        for chunk in tx.chunks(batches):
            for at in range(0, chunk.num_rows, DOCUMENTS):
                batch = chunk.slice(at, DOCUMENTS)
                words = tx.split(batch.column(1), tx.ALPHANUMERIC, lower=True)
                doc, term, tf = known.counts(words)
                m = 75 + (25 * words.counts * known.documents) // max(1, known.words)
                impact = known.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                some = impact > 0
                search_block(known, best, batch.column(0).to_numpy(), doc[some], term[some], impact[some])
        item, at = np.nonzero(best.score)
        yield pa.record_batch([pa.array(known.rows[item]), pa.array(best.doc[item, at]), pa.array(best.score[item, at])], ["row", "doc_id", "score"])

    return run


def _blocks(queries: DataFrame, limit: int) -> Iterator[Block]:
    rows, size = [], 0
    for r in queries.select("row", "terms", "times").toLocalIterator():
        if rows and size + 16 * len(r.terms) > limit:
            yield Block(rows)
            rows, size = [], 0
        rows.append((r.row, np.array(r.terms, np.int64).view(np.uint64), np.array(r.times, np.int64)))
        size += 16 * len(r.terms)
    if rows:
        yield Block(rows)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 for each row of items.

    docs needs doc_id and text, items item_id and text; others are ignored.
    Equal scores go by doc_id; a null doc_id counts as the largest. Repeated rows of
    docs are documents of their own. Each row of items is an item of its own,
    so rows that share an item_id (or have none) each get their ranks. Items without
    terms, or whose terms no document has, have no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    queries = checkpointed(numbered.mapInArrow(in_tasks(_item_terms), "row long, item_id long, terms array<long>, times array<long>").where("size(terms) > 0"))
    levels = max(1, math.isqrt(max(1, spark.sparkContext.defaultParallelism)))
    found = []
    for block in _blocks(queries, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        counts = texts.mapInArrow(in_tasks(_count(sent)), "term int, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).toArrow()  # a row for each term of the block
        term, df, n = (counts[c].to_numpy() for c in ("term", "df", "n"))
        by_term = np.zeros(len(block.terms), np.int64)
        by_term[term[term >= 0]] = df[term >= 0]
        sent.unpersist()
        weighed = spark.sparkContext.broadcast(block.weigh(int(df[term < 0].sum()), int(n[term < 0].sum()), by_term))
        rows = texts.mapInArrow(in_tasks(_search(weighed, k)), "row long, doc_id long, score long")
        order = [F.desc("score"), "doc_id"]
        first = rows.withColumn("level", F.pmod(F.spark_partition_id(), F.lit(levels))).withColumn("rank", F.row_number().over(Window.partitionBy("row", "level").orderBy(*order))).where(F.col("rank") <= k)
        best = first.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
        found.append(checkpointed(best.select("row", "rank", "doc_id", "score")))
        weighed.unpersist()
    if not found:
        return queries.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    all_found = found[0]
    for x in found[1:]:
        all_found = all_found.unionByName(x)
    return all_found.join(queries.select("row", "item_id"), "row").select("item_id", "rank", F.nullif("doc_id", F.lit(int(NULL_ID))).alias("doc_id"), "score")


SQL = r"""
with terms as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents
), wanted as (
    select item_id, term, count(*) as times from (
        select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
    group by item_id, term
), lengths as (select doc_id, count(*) as n from terms group by doc_id),
total as (select count(*) as docs, cast(sum(n) as bigint) as words from lengths),
tf as (select doc_id, term, count(*) as tf from terms where term in (select term from wanted) group by doc_id, term),
weights as (select term, cast(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from tf, total group by term),
scores as (
    select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words))))) as bigint) as score
    from wanted join weights using (term) join tf using (term) join lengths using (doc_id), total
    group by item_id, doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
where rank <= 20
"""
