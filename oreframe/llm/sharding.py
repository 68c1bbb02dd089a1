"""Sharding by a minimax contiguous partition.

Documents of equal text form an atomic group. Groups stand in the order of a
64-bit hash of their text, and the smallest capacity is sought for which
`shards` contiguous runs of groups hold everything: a binary search over the
capacity, with a greedy check of each. The cuts go where the greedy check puts them.

The driver sees bytes per range of the hash, never groups as such: the search
starts on 2**14 ranges and splits, again and again, only those ranges in which a
cut can fall. It ends when each of these is a single group, so the capacity is
exactly the smallest one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import checkpointed

FIRST_BITS, STEP_BITS = 14, 8


def _cuts(sums: np.ndarray, fluid: np.ndarray, capacity: int, shards: int) -> list[tuple[int, int]] | None:
    """(range, bytes before the cut) of the greedy cuts, or None if shards runs don't hold everything. Fluid ranges can be cut anywhere."""
    ends = np.cumsum(sums)
    total, at, out = int(ends[-1]) if len(ends) else 0, 0, []
    while at + capacity < total:
        if len(out) == shards - 1:
            return None
        i = int(np.searchsorted(ends, at + capacity, "right"))  # the range that doesn't fit
        to = at + capacity if fluid[i] else int(ends[i] - sums[i])
        if to <= at:
            return None
        out.append((i, to))
        at = to
    return out


def smallest_capacity(sums: np.ndarray, shards: int, fluid: np.ndarray | None = None) -> int:
    fluid = np.zeros(len(sums), bool) if fluid is None else fluid
    low, high = -(-int(sums.sum()) // shards), int(sums.sum())
    while low < high:
        mid = (low + high) // 2
        if _cuts(sums, fluid, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def cut_keys(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Keys at which the shards after the first begin, and the capacity, for groups of (key long, bytes)."""
    spark = groups.sparkSession

    def read(df: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
        prefix = F.shiftright("key", shift)
        return [(r[0] << shift, shift, r[1], r[2]) for r in df.groupBy(prefix.alias("x")).agg(F.sum("bytes"), F.count("*")).toLocalIterator()]

    ranges = sorted(read(groups, 64 - FIRST_BITS))
    while True:
        sums = np.array([x[2] for x in ranges], np.int64)
        fluid = np.array([x[3] > 1 and x[1] > 0 for x in ranges], bool)
        high, low = smallest_capacity(sums, shards), smallest_capacity(sums, shards, fluid)
        if high == low:
            return [ranges[i][0] for i, _ in _cuts(sums, np.zeros(len(sums), bool), high, shards)], high
        split = _undecided(sums, fluid, low, high, shards) & fluid
        chosen = [x for x, s in zip(ranges, split if split.any() else fluid, strict=True) if s]
        kept = set(ranges) - set(chosen)
        for shift in {x[1] for x in chosen}:
            # as many rows as chosen ranges, each of which the driver holds anyway
            names = spark.createDataFrame([(x[0] >> shift,) for x in chosen if x[1] == shift], "x long")
            kept |= set(read(groups.join(F.broadcast(names), F.shiftright("key", shift) == F.col("x"), "left_semi"), max(0, shift - STEP_BITS)))
        ranges = sorted(kept)


def _undecided(sums: np.ndarray, fluid: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """The ranges in which a greedy cut can fall for a capacity from low to high."""
    ends = np.cumsum(sums)
    starts, out = ends - sums, np.zeros(len(sums), bool)
    early, late = 0, 0
    for _ in range(shards - 1):
        i, j = (min(len(sums) - 1, int(np.searchsorted(ends, x, "right"))) for x in (early + low, late + high))
        out[i : j + 1] = True
        early = int(starts[i]) if starts[i] > early else int(ends[i])
        late = late + high if fluid[j] else max(late, int(starts[j]))
        if early >= ends[-1]:
            break
    return out


def assign_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, rows_per_part: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text; others are ignored).

    size is the text's UTF-8 bytes plus overhead. Null and empty texts are one
    group, of crc32 0. Rows of equal text, repeated ids included, stay in one
    shard, even if the group is larger than a fair share; no law but `bytes` is
    tried. Slots number each shard's rows from 0, without gaps. Shards beyond
    the last cut stay empty; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("key"),
    ))
    groups = checkpointed(base.groupBy("key").agg(F.sum("size").alias("bytes")))
    cuts, _ = cut_keys(groups, shards)
    shard = sum([(F.col("key") >= F.lit(k)).cast("int") for k in cuts], F.lit(0))
    parts = max(1, -(-base.count() // (shards * rows_per_part)))
    rows = base.withColumns({"shard": shard, "part": F.pmod(F.xxhash64("doc_id"), F.lit(parts))})
    order = W.partitionBy("shard", "part").orderBy("doc_id", "key")
    offsets = rows.groupBy("shard", "part").count().select("shard", "part", (F.sum("count").over(W.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    return (
        rows.withColumn("rank", F.row_number().over(order) - 1)
        .join(offsets, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
