"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to floor((a.x + b) / width) for a few Gaussian a. A query
visits its own bucket and then perturbed buckets, in the order of their
estimated success: the template of perturbation sets is ordered by the expected
squared distances to the bucket's borders, and each query applies it to its own
borders, nearest first.

Vectors are dealt by bucket, once for each table, and a query goes to the buckets
that it visits; distances are worked out there, for the vectors of those buckets
alone, and each partition sends the k + 1 nearest of a query. Buckets of more than
HOT vectors are dealt in salted parts, each of which is visited. Equal vectors of a
chunk are one row with their k + 1 smallest ids. The number of probes is the least
that finds `recall` of the true neighbours in a bounded sample. Queries for which
fewer than k vectors turn up, and all if no number of probes reaches recall, are
answered by a scan of everything, a bounded block of queries at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange as ex
from . import _text as tx
from ._spark import checkpointed, in_tasks

SAMPLE, QUERY_BLOCK, PIECE = 4_000, 4_096, 1_024
#: Vectors of a bucket in one part, and of a partition about (each vector counts once for each table).
HOT, PARTITION = 16_384, 65_536
#: Pairs of query and vector whose distances are worked out at once.
PAIRS = 8_192
PROBES = (1, 2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
FOUND = "q long, found array<struct<d:double,id:long>>"
_STRUCT = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))


class Tables:
    """Hash tables, with `probes` buckets visited in each."""

    def __init__(self, dim: int, width: float, tables: int = 16, functions: int = 16, probes: int = 16, seed: int = 11):
        r = np.random.default_rng(seed)
        self.a = r.normal(size=(tables, dim, functions)) / width
        self.b = r.random((tables, functions))
        self.code = r.integers(1, 1 << 62, (tables, functions), dtype=np.int64) * 2 + 1
        self.m = functions
        self.limit(probes)

    def limit(self, probes: int) -> Tables:
        self.sets = perturbations(self.m, probes)
        return self

    def keys(self, t: int, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (np.floor(x @ self.a[t] + self.b[t]).astype(np.int64) * self.code[t]).sum(1) + self.code[t, 0]

    def probe_keys(self, t: int, x: np.ndarray) -> np.ndarray:
        """A row of bucket keys for each query, likeliest first."""
        f = x @ self.a[t] + self.b[t]
        low = f - np.floor(f)
        order = np.argsort(np.concatenate([low, 1 - low], 1), axis=1, kind="stable")
        with np.errstate(over="ignore"):
            move = np.where(order < self.m, -self.code[t][order % self.m], self.code[t][order % self.m])
            own = self.keys(t, x)
            return np.stack([own + sum((move[:, j - 1] for j in s), np.zeros(len(x), np.int64)) for s in self.sets], 1)

    def candidates(self, queries: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each query and vector, whether the query visits a bucket of the vector's; for samples."""
        mask = np.zeros((len(queries), len(x)), bool)
        for t in range(len(self.a)):
            keys = self.keys(t, x)
            order = np.argsort(keys, kind="stable")
            q, v = _visits(self.probe_keys(t, queries), keys[order])
            mask[q, order[v]] = True
        return mask


def _visits(probes: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of probes, place in sorted_keys) of each pair of equal keys."""
    probes = probes.reshape(len(probes), -1)
    first, last = np.searchsorted(sorted_keys, probes, "left"), np.searchsorted(sorted_keys, probes, "right")
    n = (last - first).ravel()
    at = np.repeat(first.ravel() - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(np.repeat(np.arange(len(probes)), probes.shape[1]), n), at


def perturbations(m: int, count: int) -> list[tuple[int, ...]]:
    """Sets of border ranks (1 to 2m, nearest first) in ascending order of expected squared distance; never both borders of one function."""
    j = np.arange(1, 2 * m + 1)
    k = 2 * m + 1 - j
    z = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(z[0], (1,))]
    while heap and len(out) < count:
        score, s = heapq.heappop(heap)
        if all(2 * m + 1 - x not in s for x in s):
            out.append(s)
        if s[-1] < 2 * m:
            heapq.heappush(heap, (score - z[s[-1] - 1] + z[s[-1]], (*s[:-1], s[-1] + 1)))
            heapq.heappush(heap, (score + z[s[-1]], (*s, s[-1] + 1)))
    return out


def _fit(sample: np.ndarray, k: int, recall: float) -> Tables | None:
    """Width and probes for a sample of vectors; None if no number of probes reaches recall."""
    x = sample[:SAMPLE]
    q = x[:200]
    d = np.sqrt(np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0))
    d[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : max(1, min(k, len(x) - 1))]
    scale = float(np.median(np.take_along_axis(d, near, 1))) if len(x) > 1 else 1.0
    tables = Tables(x.shape[1], 3.5 * scale if np.isfinite(scale) and scale > 0 else 1.0)
    for probes in PROBES:
        tables.limit(probes)
        if np.take_along_axis(tables.candidates(q, x), near, 1).mean() >= recall:
            return tables
    return None


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _row_codes(x: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(x + 0.0).view(np.uint8).reshape(-1)  # + 0.0: -0 and 0 are equal
    ends = np.arange(1, len(x) + 1) * (len(raw) // max(1, len(x)))
    return tx.span_hashes(raw, ends - len(raw) // max(1, len(x)), ends).view(np.int64)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(_row_codes(_matrix(batch.column(1))), pa.int64())], ["id", "v", "q"])


def _distinct(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different vectors of a batch (id, v) and the k smallest ids of each."""
    ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
    code = _row_codes(x)
    order = np.lexsort((ids, code))
    first, _ = tx.groups(code[order])
    return x[order[first]], [np.unique(own)[:k] for own in np.split(ids[order], first[1:])]


def _bucket_sizes(tables) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                x, _ = _distinct(batch.slice(at, PIECE), 1)
                for t in range(len(tables.value.a)):
                    key, n = np.unique(tables.value.keys(t, x.astype(np.float64)), return_counts=True)
                    yield pa.record_batch([pa.array(key), pa.array(n, pa.int64())], ["key", "n"])

    return run


def _to_buckets(tables, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                x, ids = _distinct(batch.slice(at, PIECE), k + 1)
                v = pa.array(list(x), pa.list_(pa.float32()))
                for t in range(len(tables.value.a)):
                    yield pa.record_batch([pa.array(tables.value.keys(t, x.astype(np.float64))), pa.nulls(len(x), pa.int64()), v, pa.array(ids, pa.list_(pa.int64()))], ["key", "q", "v", "ids"])

    return run


def _to_visits(tables) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                x = _matrix(piece.column(1)).astype(np.float64)
                for t in range(len(tables.value.a)):
                    probes = tables.value.probe_keys(t, x)
                    row = pa.array(np.repeat(np.arange(len(x)), probes.shape[1]))
                    yield pa.record_batch([pa.array(probes.ravel()), piece.column(0).take(row), piece.column(1).take(row), pa.nulls(len(row), pa.list_(pa.int64()))], ["key", "q", "v", "ids"])

    return run


class _Best:
    """The k nearest of each query among the pairs seen."""

    def __init__(self, k: int):
        self.k, self.q, self.d, self.id = k, np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        q, d, ids = np.concatenate((self.q, q)), np.concatenate((self.d, d)), np.concatenate((self.id, ids))
        o = np.lexsort((ids, d, q))
        q, d, ids = q[o], d[o], ids[o]
        keep = np.ones(len(q), bool)  # a vector met in several tables counts once
        keep[1:] = (q[1:] != q[:-1]) | (d[1:] != d[:-1]) | (ids[1:] != ids[:-1])
        q, d, ids = q[keep], d[keep], ids[keep]
        first, group = tx.groups(q)
        keep = np.arange(len(q)) - first[group] < self.k if len(q) else np.zeros(0, bool)
        self.q, self.d, self.id = q[keep], d[keep], ids[keep]

    def batch(self, codes: np.ndarray) -> pa.RecordBatch:
        first, _ = tx.groups(self.q)
        pairs = pa.StructArray.from_arrays([pa.array(self.d), pa.array(self.id)], ["d", "id"])
        return pa.record_batch([pa.array(codes[self.q[first]], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(first, len(self.q)), pa.int32()), pairs).cast(_STRUCT)], ["q", "found"])


def _nearest_pairs(best: _Best, queries: np.ndarray, x: np.ndarray, ids: list[np.ndarray], q: np.ndarray, v: np.ndarray) -> None:
    """Adds the pairs (q, v) of rows of queries and x to best."""
    count = np.array([len(i) for i in ids], np.int64)
    begin, flat = np.cumsum(count) - count, np.concatenate(ids) if ids else np.empty(0, np.int64)
    held: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), PAIRS):
        a, b = q[at : at + PAIRS], v[at : at + PAIRS]
        d = np.sqrt(((x[b].astype(np.float64) - queries[a]) ** 2).sum(1))
        n = count[b]
        own = flat[np.repeat(begin[b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        held.append((np.repeat(a, n), np.repeat(d, n), own))
        if len(held) == 16 or at + PAIRS >= len(q):
            best.add(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held = []


def _search_buckets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        is_query = np.array(table["q"].is_valid())
        ours, theirs = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        if not ours.num_rows or not theirs.num_rows:
            return
        keys = theirs["key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        x, ids = _matrix(theirs["v"].combine_chunks()), theirs["ids"].combine_chunks()
        ids = np.split(ids.values.to_numpy(), ids.offsets.to_numpy()[1:-1])
        codes, one, number = np.unique(ours["q"].to_numpy(), return_index=True, return_inverse=True)
        queries = _matrix(ours["v"].combine_chunks())[one].astype(np.float64)
        visit, best, keys = ours["key"].to_numpy(), _Best(k + 1), keys[order]
        for at in range(0, len(visit), PIECE):
            q, v = _visits(visit[at : at + PIECE], keys)
            pair = np.unique(number[at + q] * np.int64(len(x)) + order[v])
            _nearest_pairs(best, queries, x, ids, pair // len(x), pair % len(x))
        yield best.batch(codes)

    return run


def _scan_all(block, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, queries = block.value
        best = _Best(k + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                x, ids = _distinct(batch.slice(at, PIECE), k + 1)
                y, some = x.astype(np.float64), min(k + 1, len(x))
                for a in range(0, len(codes), 512):
                    rough = (queries[a : a + 512] ** 2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * queries[a : a + 512] @ y.T
                    worst = np.partition(rough, some - 1, axis=1)[:, some - 1]  # with a margin for rounding
                    q, v = np.nonzero(rough <= (worst + 1e-9 * (1 + np.abs(worst)))[:, None])
                    _nearest_pairs(best, queries, x, ids, a + q, v)
        yield best.batch(codes)

    return run


def _nearest_of(parts: DataFrame, k: int) -> DataFrame:
    return parts.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k + 1).alias("found"))


def _by_scan(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest of each distinct query (q, v) among all vectors, as (q, found): a job for each bounded block of queries."""
    context = vectors.sparkSession.sparkContext
    blocks, out = max(1, -(-queries.count() // QUERY_BLOCK)), vectors.sparkSession.createDataFrame([], FOUND)
    for b in range(blocks):
        rows = list(queries.where(F.pmod(F.hash("q"), F.lit(blocks)) == b).select("q", "v").toLocalIterator())  # about QUERY_BLOCK rows
        if rows:
            block = context.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))
            out = out.unionByName(checkpointed(_nearest_of(vectors.mapInArrow(in_tasks(_scan_all(block, k)), FOUND), k)))
            block.unpersist()
    return out


def _by_buckets(vectors: DataFrame, queries: DataFrame, tables: Tables, k: int) -> DataFrame:
    """The k + 1 nearest of each distinct query (q, v) among the vectors of the buckets that it visits, as (q, found)."""
    known = vectors.sparkSession.sparkContext.broadcast(tables)
    sizes = vectors.mapInArrow(in_tasks(_bucket_sizes(known)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = checkpointed(sizes.where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).alias("salts")))
    hot = F.broadcast(hot) if hot.count() <= 10_000 else hot.hint("merge")  # rows of 16 bytes
    row = "key long, q long, v array<float>, ids array<long>"
    one = F.coalesce("salts", F.lit(1))
    ours = vectors.mapInArrow(in_tasks(_to_buckets(known, k)), row).join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64(F.get("ids", 0)), one))
    visits = queries.select("q", "v").mapInArrow(in_tasks(_to_visits(known)), row).join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)))
    parts = max(1, -(-vectors.count() * len(tables.a) // PARTITION))
    both = ours.unionByName(visits).select(F.pmod(F.xxhash64("key", "salt"), F.lit(parts)).cast("int").alias("part"), "key", "q", "v", "ids")
    return _nearest_of(ex.exchange(parts, _search_buckets(k), FOUND, both), k)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.94) -> DataFrame:
    """query_id, rank, vec_id, score (distance): the k nearest vectors found for each query, by its own id never itself.

    Both tables have vec_id and embedding (array of numbers; other columns are
    ignored). Vectors that are null, zero, hold null or non-finite components, or
    differ from the most common length take no part. Ties go to the smaller id. Rows that
    repeat an id are candidates each, or one if their vectors are equal too. With fewer than
    k candidates all are returned; empty tables give an empty result.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<float>")
        fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(fine)

    all_ = usable(vectors)
    common = all_.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    all_ = all_.where(F.size("v") == (common["n"] if common else 0))
    asked = usable(queries).where(F.size("v") == (common["n"] if common else 0))
    asked = checkpointed(asked.mapInArrow(_code, "id long, v array<float>, q long"))
    distinct = checkpointed(asked.groupBy("q").agg(F.any_value("v").alias("v")))
    sample = all_.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()  # bounded: SAMPLE vectors
    tables = _fit(np.array([r[0] for r in sample], np.float64), k, recall) if sample else None
    if tables is None:
        found = _by_scan(all_, distinct, k)
    else:
        found = checkpointed(_by_buckets(all_, distinct, tables, k))
        short = distinct.join(found.where(F.size("found") > k), "q", "left_anti")
        if not short.isEmpty():
            full = checkpointed(_by_scan(all_, short, k))
            found = found.join(full.select("q"), "q", "left_anti").unionByName(full)
    # an occurrence of the query's own id is the query itself
    own = F.array_position(F.transform("found", lambda x: x["id"]), F.col("id")).cast("int")
    rest = F.when(own > 0, F.concat(F.slice("found", F.lit(1), own - 1), F.slice("found", own + 1, F.size("found")))).otherwise(F.col("found"))
    return (
        asked.join(found, "q").select(F.col("id").alias("query_id"), F.posexplode(F.slice(rest, 1, k)).alias("rank", "x"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
    )
