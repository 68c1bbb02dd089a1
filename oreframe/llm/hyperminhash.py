"""Near-duplicate components by HyperMinHash.

1. Every shingle of a set falls into a bucket; of each bucket's smallest hash only the
   number of leading zeros and the next MANTISSA bits are kept, 16 bits a bucket. An
   empty bucket borrows from the filled one that comes first in an order of its own, so that
   registers of short texts agree as often as those of long ones of the same similarity.
   Texts with the same shingle set are one entity, named by a hash of the set.
2. Bands of registers that several entities share make them candidates. Each entity is
   at home with the smallest entity it shares a band with; homes are split into
   parts of bounded rows and shingles, and a part's members (and the home's first one)
   are linked in one task.
3. Where entities of different components still share a band, those of the smaller
   component ask the homes of the others.

Inside a task the Jaccard similarity is estimated from the registers first, corrected
for registers that agree by chance; only pairs whose estimate is within DEVIATIONS
standard deviations of the threshold are compared, by their full shingle sets. A link is
looked for only between different components, which loses none. No pairs are emitted but links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._exchange import NULL_ID
from ._spark import checkpointed, in_tasks, join_hot
from .graph import connected_components
from .jaccard import shingle_sets

#: Registers of a band and bands. Sets of Jaccard similarity 0.8 share no band with a probability of 5e-6.
ROWS, BANDS = 7, 52
BUCKETS = ROWS * BANDS
MANTISSA = 10
DEVIATIONS = 5
#: Sets sketched at once.
SETS = 4096
_SALT = np.uint64(0xD6E8FEB86659FD93)
#: Row i: the place of each bucket in the order in which bucket i borrows.
_BORROWING = np.random.default_rng(20240301).permuted(np.tile(np.arange(BUCKETS, dtype=np.uint16), (BUCKETS, 1)), axis=1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BUCKETS registers for each set of 64-bit hashes, none of which is empty."""
    low = np.full((len(sets), BUCKETS), np.iinfo(np.uint64).max, np.uint64)
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = ((tx.mix(h) >> np.uint64(32)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(low.reshape(-1), own * BUCKETS + bucket, tx.mix(h ^ _SALT))
    high, rest = (low >> np.uint64(32)).astype(np.float64), (low & np.uint64(0xFFFFFFFF)).astype(np.float64)
    zeros = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(rest)[1]).astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(62))
    mantissa = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    full = np.zeros(low.size, bool)
    full[own * BUCKETS + bucket] = True
    full = full.reshape(low.shape)
    out = ((zeros << np.uint64(MANTISSA)) | mantissa).astype("<u2")
    for i in np.flatnonzero(~full.all(1)):
        have, lack = np.flatnonzero(full[i]), np.flatnonzero(~full[i])
        out[i, lack] = out[i, have[_BORROWING[np.ix_(lack, have)].argmin(1)]]
    return out


def accidental(n: np.ndarray, m: int) -> np.ndarray:
    """Probability that a bucket's registers of two unrelated sets of n and m hashes agree, where both have one.

    The smallest of a bucket's hashes has about the density a * exp(-a x) with a = n / BUCKETS, and a
    register with i leading zeros spans 2 ** -(i + 1 + MANTISSA).
    """
    a, b = np.asarray(n, np.float64) / BUCKETS, m / BUCKETS
    i = np.arange(63)
    s = np.multiply.outer(a + b, 0.5 ** (i + 1))
    p = ((np.exp(-s) - np.exp(-2 * s)) * 0.5 ** (i + 1 + MANTISSA)).sum(-1) * a * b / (a + b)
    return p / (-np.expm1(-a) * -math.expm1(-b))


def near(own: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated similarity of others' registers with own's, whether it could reach the threshold)."""
    p = accidental(sizes, n)
    estimate = ((others == own).mean(1) - p) / (1 - p)
    return estimate, estimate >= threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / np.minimum(np.minimum(sizes, n), BUCKETS))


def _sketch(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in tx.chunks(batches):
            for at in range(0, chunk.num_rows, SETS):
                batch = chunk.slice(at, SETS)
                sets = list(shingle_sets(tx.split(batch.column(2), tx.BLANK_SEPARATED, lower=True), size))
                n = np.array([len(s) for s in sets], np.int64)
                entity = entities(sets, n)
                _, one = np.unique(entity, return_index=True)
                one = one[n[one] > 0]
                kept: list[bytes | None] = [None] * len(sets)
                for i, r in zip(one.tolist(), registers([sets[i] for i in one]), strict=True):
                    kept[i] = r.tobytes()
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(entity), pa.array(n), pa.array(kept, pa.binary())], ["doc_id", "row", "entity", "n", "registers"])

    return run


def entities(sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    out = np.array([int(tx.mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
    return tx.mix(out + n.astype(np.uint64)).view(np.int64)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
        yield pa.record_batch([pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), *batch.columns[1:]], ["body", "length", *batch.schema.names[1:]])


class _Members:
    """Rows of a part, whose sets are worked out when first asked for."""

    def __init__(self, rows: pa.Table, size: int):
        column = lambda name: rows[name].to_pylist()
        self.size, self.codec, self.sets = size, pa.Codec("zstd"), {}
        self.entity, self.component, self.body, self.length = column("entity"), column("component"), column("body"), column("length")
        self.n, self.asks = np.array(column("n"), np.int64), np.array(column("asks"), bool)
        self.registers = np.frombuffer(b"".join(column("registers")), "<u2").reshape(-1, BUCKETS)

    def shingles(self, i: int) -> np.ndarray:
        if i not in self.sets:
            text = self.codec.decompress(self.body[i], self.length[i], asbytes=True)
            self.sets[i] = next(shingle_sets(tx.split(pa.array([text], pa.binary()), tx.BLANK_SEPARATED, lower=True), self.size))
        return self.sets[i]


def links(rows: _Members, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of components that a link joins: of all members if none asks, else of each that asks with those that don't."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    inside = np.flatnonzero(~rows.asks)
    inside = inside[np.argsort(rows.n[inside], kind="stable")]
    askers = np.flatnonzero(rows.asks)
    for turn, i in enumerate((askers if len(askers) else inside).tolist()):
        among = inside if len(askers) else inside[:turn]
        # ascending sizes: those in reach are neighbours
        a, b = np.searchsorted(rows.n[among], [-(-rows.n[i] * num // den), rows.n[i] * den // num + 1])
        among = among[a:b]
        mine = root(rows.component[i])
        if not len(among) or all(root(rows.component[j]) == mine for j in among):
            continue
        estimate, maybe = near(rows.registers[i], int(rows.n[i]), rows.registers[among], rows.n[among], num / den)
        for j in among[maybe][np.argsort(-estimate[maybe], kind="stable")].tolist():
            mine = root(rows.component[i])
            if root(rows.component[j]) == mine:
                continue
            x, y = rows.shingles(i), rows.shingles(j)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            if int((y[at] == x).sum()) * (num + den) >= num * (len(x) + len(y)):
                parent[root(rows.component[j])] = mine
                out.append((rows.component[i], rows.component[j]))
    return out


def _linker(size: int, num: int, den: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        found = links(_Members(table, size), num, den)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _asking(members: DataFrame, placed: DataFrame, link: Callable, part_size: int, part_shingles: int) -> DataFrame:
    """Pairs of components linked by entities and the parts of other homes in which a larger component shares a band with them."""
    ranked = placed.select("entity", "g", "sub", "component", F.struct("count", "component").alias("rank"))
    entries = members.select("key", "entity").join(ranked.hint("merge"), "entity")
    mixed = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    entries = checkpointed(entries.join(mixed.hint("merge"), "key").drop("component"))
    cell = entries.groupBy("key", F.col("g").alias("to_g"), F.col("sub").alias("to_sub")).agg(F.max("rank").alias("top"))
    elsewhere = (F.col("top") > F.col("rank")) & ((F.col("g") != F.col("to_g")) | (F.col("sub") != F.col("to_sub")))
    wanted = checkpointed(entries.join(cell.hint("merge"), "key").where(elsewhere).select("entity", "to_g", "to_sub").distinct())
    load = wanted.join(placed.select("entity", "n"), "entity").groupBy("to_g", "to_sub").agg(F.ceil(F.greatest(F.count("*") / (4 * part_size), F.sum("n") / part_shingles)).alias("turns"))
    columns = ["g", "sub", "turn", "entity", "n", "registers", "body", "length", "component", "asks"]
    askers = (
        wanted.join(load, ["to_g", "to_sub"]).join(placed.drop("g", "sub"), "entity")
        .select(F.col("to_g").alias("g"), F.col("to_sub").alias("sub"), F.pmod(F.xxhash64("entity"), F.col("turns")).alias("turn"), "entity", "n", "registers", "body", "length", "component", F.lit(True).alias("asks"))
    )
    asked = placed.join(load.withColumnsRenamed({"to_g": "g", "to_sub": "sub"}), ["g", "sub"]).withColumns({"turn": F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)), "asks": F.lit(False)})
    return askers.select(*columns).unionByName(asked.select(*columns)).groupBy("g", "sub", "turn").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 2, share: tuple[int, int] = (4, 5), part_size: int = 512, part_shingles: int = 1 << 21) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; others are ignored).

    Words are blank-separated, with A-Z in lower case; a text of fewer than size words
    is one shingle. Documents link at a Jaccard similarity of share[0] / share[1] or more,
    confirmed on full sets. component_id is the smallest id reachable, and kept tells
    whether that is the row's own. Null and empty texts have no shingles and stand alone. A
    null doc_id counts as the largest and is null again in the result: such a row is kept
    unless a row with an id is reachable. Repeated rows are linked with each other, and share their kept.
    """
    num, den = share
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = named.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    sketches = checkpointed(named.mapInArrow(in_tasks(_sketch(size)), "doc_id long, row long, entity long, n long, registers binary"))
    sketched = sketches.where("registers is not null")

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("i"), F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)).alias("r")))
    bands = sketched.select("entity", F.explode(band).alias("x")).select(F.xxhash64("x.i", "x.r").alias("key"), "entity")
    shared = bands.groupBy("key").agg(F.min("entity").alias("leader"), F.max("entity").alias("last")).where("leader < last").select("key", "leader")
    members = checkpointed(bands.join(shared.hint("merge"), "key").distinct())

    home = members.groupBy("entity").agg(F.min("leader").alias("g"))
    active = sketched.join(home.hint("merge"), "entity").groupBy("entity", "g").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.min("registers").alias("registers"))
    per_home = active.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / part_size, F.sum("n") / part_shingles)).alias("subs"))
    chosen = checkpointed(active.join(per_home.hint("merge"), "g").withColumn("sub", F.pmod(F.xxhash64("entity"), F.col("subs"))))
    with_text = named.select("text", "row").join(chosen.hint("merge"), "row").drop("row")
    schema = ", ".join(["body binary", "length long", *(f"{c} {t}" for c, t in with_text.dtypes if c != "text")])
    # a row may stand in docs repeatedly
    placed = checkpointed(with_text.mapInArrow(in_tasks(_compress), schema).dropDuplicates(["entity"]))

    link = _linker(size, num, den)
    shape = ["g", "sub", "entity", "n", "registers", "body", "length", "component", "asks"]
    own = placed.withColumns({"component": F.col("entity"), "asks": F.lit(False)})
    leaders = own.where("entity = g and subs > 1").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).where("at <> sub").drop("sub").withColumnRenamed("at", "sub")
    found = checkpointed(own.select(*shape).unionByName(leaders.select(*shape)).groupBy("g", "sub").applyInArrow(link, "a long, b long"))
    components = connected_components(found)
    labels = components.join(components.groupBy("component").count().hint("merge"), "component").select(F.col("v").alias("entity"), "component", "count")
    labelled = placed.join(labels.hint("merge"), "entity", "left").withColumns({"component": F.coalesce("component", "entity"), "count": F.coalesce("count", F.lit(1).cast("long"))})
    joined = connected_components(_asking(members, labelled, link, part_size, part_shingles)).select(F.col("v").alias("was"), F.col("component").alias("now"))
    single = joined.join(components.select(F.col("component").alias("was")).hint("merge"), "was", "left_anti").select(F.col("was").alias("v"), F.col("now").alias("component"))
    final = components.join(joined.hint("merge"), F.col("component") == F.col("was"), "left").select("v", F.coalesce("now", "component").alias("component")).unionByName(single)

    by_entity = sketches.groupBy("entity").agg(F.min("doc_id").alias("least"), F.max("n").alias("size"))
    rooted = checkpointed(by_entity.where("size > 0").join(final.withColumnRenamed("v", "entity").hint("merge"), "entity", "left").select("entity", "least", F.coalesce("component", "entity").alias("root")))
    roots = checkpointed(join_hot(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("entity", "component_id"))
    out = join_hot(sketches.select("doc_id", "entity", "n"), roots, "entity", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(
        F.nullif("doc_id", F.lit(int(NULL_ID))).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif("component_id", F.lit(int(NULL_ID))).alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )
