"""Packed messages between tasks: many small entries (document, place, hash) as a
few binary rows, dealt by Spark with repartitionById. A part is a range of
hashes on the way there and a hash of the document id on the way back.

Parts are of a fixed size, so their number follows the data without a bound. Up to
MAX_TASKS each is a partition; beyond, a partition holds several neighbouring parts,
which Spark sorts (spilling to disk) and a task works off one after another, so that
its memory stays that of one part.

A message costs some 300 bytes beside its entries, and a sender's chunk is of a fixed size,
so with many parts a message would hold few entries. Beyond ONE_STEP parts entries therefore travel in two
steps: a chunk's messages are for groups of neighbouring parts, as many groups as parts in
each; the task of a group merges what came into messages of its parts. So what an entry
costs doesn't grow with the number of parts.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import in_tasks, shuffle_partitions

SCHEMA = "part int, kind int, body binary"
#: Kinds of messages. PLACES goes to a document's partition and passes through others.
ENTRIES, PLACES, TEXT = 0, 1, 2
#: Stands for a null id, which so counts as the largest.
NULL_ID = np.iinfo(np.int64).max
#: Marks the kind of a message whose entries are for a group of parts.
COARSE = 1 << 16
#: Most parts that a chunk's entries are dealt to in one step.
ONE_STEP = 4_096
#: Bytes of messages that are merged at a time in the second step.
MERGE_BYTES = 64 << 20


class Parts(int):
    """A number of parts. width: neighbouring ones that a message of the first step is for; 1 where one step is enough."""

    width: int

    def __new__(cls, n: int, one_step: int = ONE_STEP) -> Parts:
        self = super().__new__(cls, n)
        self.width = 1 if n <= one_step else math.isqrt(n)
        return self


def message(part: int, kind: int, *body: object) -> tuple[int, int, bytes]:
    return part, kind, pickle.dumps(body, protocol=5)


def record_batches(messages: Iterator[tuple[int, int, bytes]], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for m in messages:
        rows.append(m)
        size += len(m[2])
        if size > limit:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, body = zip(*rows, strict=True)
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], ["part", "kind", "body"])


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)


def hash_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def id_part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (tx.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int32)


def pack(parts: int, kind: int, part: np.ndarray, doc: np.ndarray, place: np.ndarray, values: list[np.ndarray] = []) -> Iterator[tuple[int, int, bytes]]:  # noqa: B006
    """Messages with the entries of each part, or group of parts; doc (ids) and place ascend within runs of one document."""
    width = getattr(parts, "width", 1)
    if width == 1:
        yield from _pack(kind, part, doc, place, values)
    else:
        yield from _pack(kind | COARSE, part - part % width, doc, place, [*values, (part % width).astype(np.uint16)])


def _narrow(x: np.ndarray) -> np.ndarray:
    """x, none of it negative, in as few bytes a value as its largest one needs."""
    return x.astype(np.min_scalar_type(x.max()))


def _pack(kind: int, part: np.ndarray, doc: np.ndarray, place: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """A message for each part with its entries. Places are stored as gaps, and ids too where that takes fewer bytes."""
    if not len(part):
        return
    at = np.argsort(part.astype(np.uint16) if part.max() < 1 << 16 else part, kind="stable")
    part, doc, place = part[at], doc[at], place[at].astype(np.int64, copy=False)
    values = [v[at] for v in values]
    cut = np.concatenate(([True], part[1:] != part[:-1]))
    new = cut | np.concatenate(([True], (doc[1:] != doc[:-1]) | (place[1:] < place[:-1])))
    run = np.flatnonzero(new)
    length = np.diff(run, append=len(part))
    doc = doc[run]
    step = np.diff(doc.astype(np.int64, copy=False))
    step = ((step << 1) ^ (step >> 63)).view(np.uint64)  # small where ids are close, whichever is larger
    gap = np.where(new, place, np.diff(place, prepend=0))
    low, high = (gap & 255).astype(np.uint8), gap >> 8
    cut = np.append(np.flatnonzero(cut), len(part))
    of = np.searchsorted(run, cut).tolist()
    part, cut = part[cut[:-1]].tolist(), cut.tolist()
    for i, to in enumerate(part):
        a, b, c, d = cut[i], cut[i + 1], of[i], of[i + 1]
        ids = doc[c:d]
        if d - c > 1 and (most := step[c : d - 1].max()) < 1 << 32:
            ids = int(doc[c]), step[c : d - 1].astype(np.min_scalar_type(most))
        yield message(to, kind, ids, _narrow(length[c:d]), low[a:b], _narrow(high[a:b]), *(v[a:b] for v in values))


#: Bytes of entries that a task holds before it makes messages of them.
HELD_BYTES = 48 << 20


class Outbox:
    """Entries of a task's chunks, held and packed together: a message for each part costs some 300 bytes and
    its making, so one for each chunk and part would hold ever fewer entries as parts grow in number."""

    def __init__(self, parts: int, limit: int | None = None):
        self.parts, self.limit = parts, HELD_BYTES if limit is None else limit
        self.held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.size = 0

    def put(self, kind: int, part: np.ndarray, doc: np.ndarray, place: np.ndarray, values: list[np.ndarray] = []) -> Iterator[tuple[int, int, bytes]]:  # noqa: B006
        """As pack, but messages come only when enough is held."""
        if not len(part):
            return
        entry = part, doc, place.astype(np.uint32), *values
        self.held.setdefault(kind, []).append(entry)
        self.size += sum(x.nbytes for x in entry)
        if self.size > self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[int, int, bytes]]:
        """Messages of all that is held."""
        while self.held:
            kind, entries = self.held.popitem()
            columns = []
            for x in zip(*entries, strict=True):
                columns.append(np.concatenate(x))
            del entries, x
            part, doc, place, *values = columns
            del columns
            yield from pack(self.parts, kind, part, doc, place, values)
        self.size = 0


def unpack(bodies: list[bytes]) -> list[np.ndarray]:
    """[doc, place, values ...] of all messages together. Empties the messages as it goes, so that they don't take memory beside the result."""
    columns: list[list[np.ndarray]] = []
    for i, body in enumerate(bodies):
        doc, n, low, high, *values = pickle.loads(body)  # noqa: S301
        bodies[i] = b""
        if isinstance(doc, tuple):
            step = doc[1].astype(np.int64)
            doc = np.cumsum(np.concatenate(([doc[0]], (step >> 1) ^ -(step & 1))))
        run = np.cumsum(n, dtype=np.int64) - n
        gap = low.astype(np.int64) | (high.astype(np.int64) << 8)
        total = np.cumsum(gap)
        place = total - np.repeat(total[run] - gap[run], n)
        columns = columns or [[] for _ in range(2 + len(values))]
        for column, x in zip(columns, (np.repeat(doc, n), place, *values), strict=True):
            column.append(x)
    out = []
    while columns:
        out.append(np.concatenate(columns.pop(0)))
    return out


def merge(limit: int = MERGE_BYTES) -> Callable:
    """The second step: messages of one group of parts, made anew for each part. Other messages pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            held: dict[tuple[int, int], list[bytes]] = {}
            size = 0

            def made() -> Iterator[tuple[int, int, bytes]]:
                for (first, kind), bodies in held.items():
                    doc, place, *values, offset = unpack(bodies)
                    yield from _pack(kind, first + offset.astype(np.int32), doc, place, values)
                held.clear()

            for part, kind, body in read(batches):
                if not kind & COARSE:
                    yield part, kind, body
                    continue
                held.setdefault((part, kind ^ COARSE), []).append(body)
                size += len(body)
                if size > limit:
                    yield from made()
                    size = 0
            yield from made()

        yield from record_batches(messages())

    return run


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Bytes of texts that a task deals out at once.
SENT_BYTES = 32 << 20


def send_texts(parts: int) -> Callable:
    """Texts to their documents' partitions, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            option = pa.ipc.IpcWriteOptions(compression="zstd")
            for batch in tx.gathered(tx.chunks(batches, limit=SENT_BYTES), limit=SENT_BYTES):
                part = id_part(batch.column(0).to_numpy(), parts)
                at = np.argsort(part, kind="stable")
                batch, part = batch.take(pa.array(at)), part[at]
                cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema, options=option) as w:
                        w.write_batch(batch.slice(a, b - a))
                    yield int(part[a]), TEXT, sink.getvalue().to_pybytes()

        yield from record_batches(messages())

    return run


def read_text(body: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(body)


class Inbox:
    """What reached a document partition: compressed texts, and places by document id."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        places, self.texts = {}, []
        for _, kind, body in read(batches):
            if kind == TEXT:
                self.texts.append(body)
            else:
                places.setdefault(kind, []).append(body)
        self.found = {}
        for kind, bodies in places.items():
            doc, place, *_ = unpack(bodies)
            at = np.lexsort((place, doc))
            doc, place = doc[at], place[at]
            keep = np.ones(len(doc), bool)
            keep[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
            doc, place = doc[keep], place[keep]
            first, _ = tx.groups(doc)
            self.found[kind] = doc[first], np.append(first, len(doc)), place

    def places(self, kind: int, doc_ids: np.ndarray) -> list[np.ndarray]:
        """The places of each of doc_ids."""
        none = np.empty(0, np.int64)
        if kind not in self.found:
            return [none] * len(doc_ids)
        ids, first, place = self.found[kind]
        at = np.minimum(np.searchsorted(ids, doc_ids), len(ids) - 1)
        return [place[a:b] if ok else none for a, b, ok in zip(first[at].tolist(), first[at + 1].tolist(), (ids[at] == doc_ids).tolist(), strict=True)]

    def chunks(self) -> Iterator[pa.RecordBatch]:
        """The texts, of as many senders together as make up a chunk: the more parts, the less a sender has for each."""
        yield from tx.chunks(tx.gathered(x for body in self.texts for x in read_text(body)))


#: Most partitions of an exchange.
MAX_TASKS = 20_000


def _one_part_at_a_time(f: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if now is not None and part[a] != now:
                    yield from f(iter(held))
                    held = []
                now = part[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from f(iter(held))

    return run


def exchange(parts: int, f: Callable, schema: str, packed: DataFrame, *others: DataFrame) -> DataFrame:
    """f over all messages, of one part at a time. Those of others are for single parts."""
    out, width = packed, getattr(parts, "width", 1)
    if width > 1:
        groups = -(-int(parts) // width)
        out = out.repartitionById(groups, F.floor(F.col("part") / width).cast("int")).mapInArrow(in_tasks(merge()), SCHEMA)
    for x in others:
        out = out.unionAll(x)
    if parts <= MAX_TASKS:
        return out.repartitionById(parts, F.col("part")).mapInArrow(in_tasks(f), schema)
    task = F.floor(F.col("part").cast("double") * MAX_TASKS / parts).cast("int")
    return out.repartitionById(MAX_TASKS, task).sortWithinPartitions("part").mapInArrow(in_tasks(_one_part_at_a_time(f)), schema)


#: Stored bytes of input for each part of an exchange.
PART_BYTES = 10 << 20


def parts_of(docs: DataFrame, part_bytes: int = PART_BYTES) -> Parts:
    """Partitions for an exchange of docs, by Spark's estimate of its size; spark.sql.shuffle.partitions where Spark has none."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return Parts(shuffle_partitions(spark))
    return Parts(min(1 << 30, max(spark.sparkContext.defaultParallelism, -(-size // part_bytes))))
