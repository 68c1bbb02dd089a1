"""N-gram Jaccard join by a token-group matrix, as components.

Texts with the same shingle set are one entity, named by a hash of the set.

1. Every shingle meets its equals in a range of hashes. An entity must share
   `share` of its shingles with others to link with any; the rest are done. This
   is the matrix's bound with all others as one group. A task settles shingles
   that its own entities share, so a frequent shingle costs an entry per task.
2. The shared shingles of an entity, frequent ones last, have a prefix of which
   any link must share one. Entities with the same first shingle are a group,
   split into parts of about `part_size`; each part's members, and the group's
   first one, are linked in one task.
3. The matrix of prefix shingle -> group gives, for each entity, the groups that
   could hold a link. An entity asks a group only if it holds a larger component
   than the entity's own. In the group, members are in blocks with the union of
   their shingles; blocks that can't reach the overlap stay closed, the others
   are compared exactly.

A link is looked for only between different components, which loses none, as
components are what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange as ex
from . import _text as tx
from ._spark import checkpointed, in_tasks, join_hot
from .graph import connected_components

DOCUMENT, SHARED = ex.PLACES + 50, ex.PLACES + 60
TABLE = "entity long, doc_id long, n long, need long, tokens array<long>"
#: Frequent shingles known to every task, for the order alone: any order gives the same result.
MOST_FREQUENT = 100_000
BLOCK = 32
#: Passes in which a task sorts its hashes, each over those of one remainder, to bound its memory.
PASSES = 8


def _need(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Least overlap of a set of n with any set it links to."""
    return -(-n * num // den)


def shingle_sets(words: tx.Words, size: int) -> Iterator[np.ndarray]:
    h = words.hashes()
    grams = tx.windows(h, size)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        else:
            yield tx.windows(h[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _send(size: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            for batch in tx.chunks(batches):
                sets = list(shingle_sets(tx.split(batch.column(1), tx.BLANK_SEPARATED, lower=True), size))
                n = np.array([len(s) for s in sets], np.int64)
                entity = np.array([int(tx.mix(s).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
                entity = tx.mix(entity + n.astype(np.uint64)).view(np.int64)
                ids = batch.column(0).to_numpy()
                o = np.argsort(entity, kind="stable")
                yield from ex.pack(parts, DOCUMENT, ex.id_part(entity[o], parts), entity[o], np.zeros(len(o), np.int64), [ids[o], n[o]])
                _, one = np.unique(entity, return_index=True)
                one = one[n[one] > 0]
                if not len(one):
                    continue
                h = np.concatenate([sets[i] for i in one])
                own = np.repeat(entity[one], n[one])
                place = np.concatenate([np.arange(k) for k in n[one]])
                o = tx.order(h)
                first, group = tx.groups(h[o])
                several = (np.diff(np.append(first, len(o))) > 1)[group]
                here = np.zeros(len(o), bool)
                here[o] = several
                send = ~here
                send[o[first]] = True
                for kind, part, m in ((ex.ENTRIES, ex.hash_part(h, parts), send), (SHARED, ex.id_part(own, parts), here)):
                    yield from ex.pack(parts, kind, part[m], own[m], place[m], [h[m]] if kind == SHARED else [(h[m] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h[m] >> np.uint64(32)).astype(np.uint32)])

        yield from ex.record_batches(messages())

    return run


def _met(own: np.ndarray, h: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Of the entries numbered in among, those whose shingle several entities hold."""
    if not len(among):
        return among
    at = among[tx.order(h[among])]
    first, group = tx.groups(h[at])
    mine = own[at]
    return at[(np.minimum.reduceat(mine, first) != np.maximum.reduceat(mine, first))[group]]


def _shared(parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def messages() -> Iterator[tuple[int, int, bytes]]:
            bodies: list[bytes] = []
            for row in ex.read(batches):
                if row[1] == ex.ENTRIES:
                    bodies.append(row[2])
                else:
                    yield row
            if not bodies:
                return
            own, place, low, high = ex.unpack(bodies)
            h = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
            del low, high
            found = np.sort(np.concatenate([_met(own, h, np.flatnonzero(h % np.uint64(PASSES) == np.uint64(k))) for k in range(PASSES)]))
            yield from ex.pack(parts, SHARED, ex.id_part(own[found], parts), own[found], place[found], [h[found]])

        yield from ex.record_batches(messages())

    return run


def _gather(num: int, den: int) -> Callable:
    """Rows of documents, and of entities with shingles enough that are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: dict[int, list[bytes]] = {DOCUMENT: [], SHARED: []}
        for _, kind, body in ex.read(batches):
            bodies[kind].append(body)
        if not bodies[DOCUMENT]:
            return
        entity, _, ids, n = ex.unpack(bodies[DOCUMENT])
        none = pa.nulls(len(ids), pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(entity), pa.array(ids), pa.array(n), pa.nulls(len(ids), pa.int64()), none], ["entity", "doc_id", "n", "need", "tokens"])
        if not bodies[SHARED]:
            return
        known, at = np.unique(entity, return_index=True)
        size = n[at]
        own, place, h = ex.unpack(bodies[SHARED])
        o = np.lexsort((h, own))
        own, h = own[o], h[o]
        keep = np.ones(len(o), bool)
        keep[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
        own, h = own[keep], h[keep]
        first, _ = tx.groups(own)
        need = _need(size[np.searchsorted(known, own[first])], num, den)
        count = np.diff(np.append(first, len(own)))
        rows = []
        for i in np.flatnonzero(count >= need):
            rows.append((own[first[i]], None, size[np.searchsorted(known, own[first[i]])], need[i], np.sort(h[first[i] : first[i] + count[i]].view(np.int64))))
            if len(rows) == 500:
                yield _entities(rows)
                rows = []
        if rows:
            yield _entities(rows)

    return run


def _entities(rows: list[tuple]) -> pa.RecordBatch:
    e, d, n, need, tokens = zip(*rows, strict=True)
    return pa.record_batch([pa.array(e, pa.int64()), pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(need, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["entity", "doc_id", "n", "need", "tokens"])


def _prefixes(frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = frequent.value
        for batch in batches:
            out = []
            for need, own in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                t = own.values.to_numpy()
                at = np.minimum(np.searchsorted(token, t), max(0, len(token) - 1))
                often = np.where(token[at] == t, count[at], 0) if len(token) else np.zeros(len(t), np.int64)
                out.append(t[np.lexsort((t, often))[: len(t) - need + 1]])
            first = [int(x[0]) for x in out]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(pa.int64())), pa.array(first, pa.int64())], ["entity", "n", "need", "tokens", "prefix", "g"])

    return run


class _Block:
    """Members with the union of their shingles."""

    def __init__(self, members: list[int], n: np.ndarray, tokens: list[np.ndarray]):
        self.members, self.least = members, min(int(n[i]) for i in members)
        self.union = np.unique(np.concatenate([tokens[i] for i in members]))


def _overlap(a: np.ndarray, sorted_b: np.ndarray) -> int:
    at = np.searchsorted(sorted_b, a)
    at[at == len(sorted_b)] = 0
    return int((sorted_b[at] == a).sum())


def link_group(entity: list[int], component: list[int], n: list[int], tokens: list[np.ndarray], asks: list[bool], num: int, den: int) -> list[tuple[int, int]]:
    """Links among different components: all members with each other if none asks, else each that asks with those that don't."""
    if all(asks):
        return []
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    size, out, blocks, open_block = np.array(n), [], [], []
    inside = [i for i in range(len(entity)) if not asks[i]]
    order = sorted(inside, key=lambda i: (int(tokens[i][0]) if len(tokens[i]) else 0, n[i]))
    everyone = not any(asks)

    def seek(i: int, block: _Block) -> None:
        if all(root(component[j]) == root(component[i]) for j in block.members):
            return
        # overlap >= num / (num + den) of both sizes together: the least that a member could do with
        if _overlap(tokens[i], block.union) * (num + den) < num * (n[i] + block.least):
            return
        for j in block.members:
            if root(component[j]) != root(component[i]) and min(n[i], n[j]) * den >= num * max(n[i], n[j]) and _overlap(tokens[i], tokens[j]) * (num + den) >= num * (n[i] + n[j]):
                parent[root(component[j])] = root(component[i])
                out.append((entity[i], entity[j]))

    if everyone:
        for i in order:
            for block in blocks:
                seek(i, block)
            if open_block:
                seek(i, _Block(open_block, size, tokens))
            open_block.append(i)
            if len(open_block) == BLOCK:
                blocks.append(_Block(open_block, size, tokens))
                open_block = []
        return out
    blocks = [_Block(order[k : k + BLOCK], size, tokens) for k in range(0, len(order), BLOCK)]
    for i in range(len(entity)):
        if asks[i]:
            for block in blocks:
                seek(i, block)
    return out


def _linker(num: int, den: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        # a repeated member (the group's first one in its own part) counts once
        tokens = [x.values.to_numpy() for x in table["tokens"].combine_chunks()] if table.num_rows else []
        links = link_group(table["entity"].to_pylist(), table["component"].to_pylist(), table["n"].to_pylist(), tokens, table["asks"].to_pylist(), num, den)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _ask(placed: DataFrame, link: Callable, part_size: int, num: int, den: int, star: bool) -> DataFrame:
    """Links between entities and groups that share a prefix shingle, fit in size and are of higher rank (hold a larger component) than the entity.

    With star an entity asks, for each shingle, only the group of the highest rank: rows
    in proportion to the shingles, which join most of what links before all groups are asked.
    """
    prefix = placed.select("entity", "g", "sub", "rank", "n", F.size("tokens").alias("size"), F.posexplode("prefix").alias("i", "t")).withColumn("rest", F.col("size") - F.col("i")).drop("i", "size")
    mixed = prefix.groupBy("t").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high").select("t", "high")
    # sizes of linked sets are in the same or in neighbouring classes
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9)
    entries = checkpointed(prefix.join(mixed.hint("merge"), "t").withColumn("level", level))
    cell = entries.groupBy("t", "level", "g", "sub").agg(F.max("rank").alias("top"), F.max("high").alias("high"), F.min("n").alias("least"), F.max("rest").alias("most"))
    if star:
        cell = cell.where("top = high").groupBy("t").agg(F.min(F.struct("level", "g", "sub", "top", "least", "most")).alias("x")).select("t", "x.*")
    near = F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1))
    cell = cell.select("t", near.alias("level"), F.col("g").alias("to_g"), F.col("sub").alias("to_sub"), "top", "least", "most")
    fits = (F.col("top") > F.col("rank")) & ((F.col("g") != F.col("to_g")) | (F.col("sub") != F.col("to_sub"))) & (F.least("rest", "most") * (num + den) >= num * (F.col("n") + F.col("least")))
    wanted = checkpointed(entries.where("rank < high").join(cell.hint("merge"), ["t", "level"]).where(fits).select("entity", "to_g", "to_sub").distinct())
    load = wanted.groupBy("to_g", "to_sub").agg(F.ceil(F.count("*") / (4 * part_size)).alias("turns"))
    columns = ["g", "sub", "turn", "entity", "n", "tokens", "component", "asks"]
    askers = wanted.join(load, ["to_g", "to_sub"]).join(placed.select("entity", "n", "tokens", "component"), "entity").select(F.col("to_g").alias("g"), F.col("to_sub").alias("sub"), F.pmod(F.xxhash64("entity"), F.col("turns")).alias("turn"), "entity", "n", "tokens", "component", F.lit(True).alias("asks"))
    asked = placed.join(load.withColumnsRenamed({"to_g": "g", "to_sub": "sub"}), ["g", "sub"]).withColumns({"turn": F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)), "asks": F.lit(False)})
    return askers.select(*columns).unionByName(asked.select(*columns)).groupBy("g", "sub", "turn").applyInArrow(link, "a long, b long")


def _shared_shingles(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """A written table of documents, and of entities with the shingles that they share. Nothing here refers to its exchanges any more, so Spark can delete their files."""
    parts = ex.parts_of(docs)
    sent = ex.texts(docs).mapInArrow(in_tasks(_send(size, parts)), ex.SCHEMA)
    return checkpointed(ex.exchange(parts, _gather(num, den), TABLE, ex.exchange(parts, _shared(parts), ex.SCHEMA, sent)))


def jaccard_components(docs: DataFrame, size: int = 5, share: tuple[int, int] = (3, 4), part_size: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text; others are ignored).

    Words are blank-separated, with A-Z in lower case; a text of fewer than size
    words is one shingle. Documents link at a Jaccard similarity of share[0] /
    share[1] or more. component_id is the smallest id reachable. Null and empty
    texts have no shingles and stand alone. A null doc_id counts as the largest
    (and is null again in the result). Repeated rows are linked with each other.
    """
    num, den = share
    spark, table = docs.sparkSession, _shared_shingles(docs, size, num, den)
    documents = table.where("need is null").select("entity", "doc_id", "n")
    active = table.where("need is not null").select("entity", "n", "need", "tokens")

    counted = active.select(F.explode("tokens").alias("t")).groupBy("t").count().where("count > 8")
    often = counted.orderBy(F.desc("count"), "t").limit(MOST_FREQUENT).toArrow().sort_by("t")  # bounded: MOST_FREQUENT rows of 16 bytes
    frequent = spark.sparkContext.broadcast((often["t"].to_numpy(), often["count"].to_numpy()))
    ready = active.mapInArrow(in_tasks(_prefixes(frequent)), "entity long, n long, need long, tokens array<long>, prefix array<long>, g long")
    per_group = ready.groupBy("g").agg(F.count("*").alias("members"), F.min("entity").alias("leader"))
    ready = checkpointed(ready.join(per_group, "g").withColumn("subs", F.ceil(F.col("members") / part_size)).withColumn("sub", F.pmod(F.xxhash64("entity"), F.col("subs"))))

    link = _linker(num, den)
    shape = ["g", "sub", F.lit(0).cast("long").alias("turn"), "entity", "n", "tokens", "component", "asks"]
    own = ready.where("members > 1").withColumns({"component": F.col("entity"), "asks": F.lit(False)})
    leaders = own.where("entity = leader and subs > 1").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).where("at <> sub").drop("sub").withColumnRenamed("at", "sub")
    links = checkpointed(own.select(*shape).unionByName(leaders.select(*shape)).groupBy("g", "sub").applyInArrow(link, "a long, b long"))
    # before components are known, the larger group counts as the larger component
    alone = ready.withColumns({"component": F.col("entity"), "rank": F.struct(F.col("members").alias("c"), F.col("g").alias("k"))})
    links = checkpointed(links.unionByName(_ask(alone, link, part_size, num, den, True)))
    components = connected_components(links)
    labels = components.join(components.groupBy("component").count().hint("merge"), "component").select(F.col("v").alias("entity"), "component", "count")
    placed = checkpointed(ready.join(labels.hint("merge"), "entity", "left").withColumns({"component": F.coalesce("component", "entity"), "rank": F.struct(F.coalesce("count", F.lit(1)).alias("c"), F.coalesce("component", "entity").alias("k"))}))
    final = connected_components(links.unionByName(_ask(placed, link, part_size, num, den, False)))

    by_entity = documents.groupBy("entity").agg(F.min("doc_id").alias("least"), F.max("n").alias("size"))
    rooted = checkpointed(by_entity.where("size > 0").join(final.withColumnRenamed("v", "entity"), "entity", "left").select("entity", "least", F.coalesce("component", "entity").alias("root")))
    roots = checkpointed(join_hot(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("entity", "component_id"))
    return (
        join_hot(documents, roots, "entity", "left")
        .select(F.nullif("doc_id", F.lit(int(ex.NULL_ID))).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component_id", "doc_id"), F.lit(int(ex.NULL_ID))).alias("component_id"))
    )
