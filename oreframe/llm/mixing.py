"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its
documents should have. The whole part is taken at once; the fractional part is
rounded by pivotal sampling: two documents exchange word mass at random, in
expectation fairly, until one of them is at 0 or 1, and the other goes on. The
exchange keeps the sum of words, so a source misses its target by less than one
document. Documents meet in a tree: each group of about `fanout` leaves one
undecided document, which goes to the next level.

DataFrame functions only. Random numbers are hashes of ids, so reruns agree, over other
file layouts too but for ids that repeat over 8 * fanout times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._spark import checkpointed

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, n_rows, source_size, target from rows of (source, size).

    Sources in code point order, null last, take the weights in turn, which
    split share * all sizes. A target stops at cap * its source's size and the
    excess goes to the rest by weight: min(cap * size, level * weight), for the
    level that gives the total. The windows below run over one row per source.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy(F.lit(1))
    s = (
        sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(total) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(total))
        .withColumn("left_words", F.col("wanted") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("left_words") >= F.col("ratio") * F.col("left_weight"))
    )
    full_words = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(total)
    full_weight = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(total)
    level = (F.col("wanted") - full_words) / F.nullif(F.col("all_weight") - full_weight, F.lit(0.0))
    return s.withColumn("level", level).select(
        "source", "n_rows", "source_size",
        F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("most"))).alias("target"),
    )


def _uniform(level: int, seed: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _exchange(state: Column, x: Column) -> Column:
    """The undecided document of state meets x; one of them is decided and appended to state.done."""
    a = state["open"]
    mass_a, mass_b = a["p"] * a["size"], x["p"] * x["size"]
    to_b = F.least(mass_a, x["size"] - mass_b)
    to_a = F.least(mass_b, a["size"] - mass_a)
    give = (x["u"] * (to_a + to_b)) < to_a
    kind = "struct<id:bigint,size:bigint,p:double,u:double,row:bigint>"
    done = lambda d, extra: F.struct(d["row"].alias("row"), F.lit(extra).alias("extra"))
    going = lambda d, p: F.struct(d["id"].alias("id"), d["size"].alias("size"), p.alias("p"), d["u"].alias("u"), d["row"].alias("row")).cast(kind)
    pair = lambda open_, decided: F.struct(open_.alias("open"), F.concat(state["done"], F.array(decided)).alias("done"))
    return (
        F.when(a.isNull(), F.struct(x.cast(kind).alias("open"), state["done"].alias("done")))
        .when(give & (to_b >= mass_a), pair(going(x, (mass_b + to_b) / x["size"]), done(a, 0)))
        .when(give, pair(going(a, (mass_a - to_b) / a["size"]), done(x, 1)))
        .when(to_a >= mass_b, pair(going(a, (mass_a + to_a) / a["size"]), done(x, 0)))
        .otherwise(pair(going(x, (mass_b - to_a) / x["size"]), done(a, 1)))
    )


def round_fractions(rows: DataFrame, fanout: int = 64, seed: int = 7) -> DataFrame:
    """row, extra (0 or 1) for rows of (row, id, size, source, p, n_rows), 0 < p < 1 and size > 0.

    row names a row, id is what its random numbers are drawn by.
    n_rows, the number of rows of the source, sets the number of groups of the
    first level. Rows with the same id fall into the same group, unless they are over 8 *
    fanout, which are dealt by row, so that no group grows with the repeats of an id.
    """
    most = rows.agg(F.max("n_rows")).first()[0] or 0
    groups = F.ceil(F.col("n_rows") / fanout).cast("long")
    often = rows.groupBy("id").count().where(F.col("count") > 8 * fanout).select("id", F.lit(True).alias("often"))
    dealt_by = F.when(F.col("often"), F.xxhash64("id", "row")).otherwise(F.col("id"))
    left = rows.join(often.hint("merge"), "id", "left").select("source", "row", "id", "size", "p", F.pmod(F.xxhash64(F.lit(seed), dealt_by), groups).alias("g"))
    decided, level, width = None, 0, max(1, -(-most // fanout))
    empty = F.expr("named_struct('open', cast(null as struct<id:bigint,size:bigint,p:double,u:double,row:bigint>), 'done', cast(array() as array<struct<row:bigint,extra:int>>))")
    while True:
        item = F.struct("id", "size", "p", _uniform(level, seed, F.col("id"), F.col("size")).alias("u"), "row")
        folded = left.groupBy("source", "g").agg(F.array_sort(F.collect_list(item)).alias("items"))
        folded = checkpointed(folded.select("source", "g", F.aggregate("items", empty, _exchange).alias("r")))
        done = folded.select(F.explode("r.done").alias("d")).select("d.row", "d.extra")
        decided = done if decided is None else decided.unionByName(done)
        left = folded.select("source", "r.open.row", "r.open.id", "r.open.size", "r.open.p", F.floor(F.col("g") / fanout).alias("g"))
        level += 1
        if width <= 1:
            break
        width = -(-width // fanout)
    last = left.select("row", (_uniform(level, seed, F.col("id"), F.col("size")) < F.col("p")).cast("int").alias("extra"))
    return decided.unionByName(last)


def mix_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, fanout: int = 64, seed: int = 7, name: str | None = None) -> DataFrame:
    """The columns of mix_sources, and named, the value of docs' column `name` (null without one).

    Each row is rounded by itself. Rows without an id are drawn by `name`, or by
    their text where that is null.
    """
    base = checkpointed(docs.select(
        F.monotonically_increasing_id().alias("row"), (F.col(name) if name else F.lit(None)).cast("long").alias("named"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"),
    ))
    targets = checkpointed(source_targets(base, weights, share, cap)).withColumnRenamed("source", "of")
    rows = base.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    want = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    whole = F.floor(want + 1e-12)
    rows = rows.withColumns({"whole": whole, "p": F.greatest(want - whole, F.lit(0.0))})
    drawn_by = F.coalesce("doc_id", F.xxhash64(F.lit("no id"), F.coalesce("named", "text_hash")))
    extra = round_fractions(rows.where((F.col("p") > 1e-12) & (F.col("size") > 0)).select("row", drawn_by.alias("id"), "size", "source", "p", "n_rows"), fanout, seed)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(0)
    return (
        rows.join(extra, "row", "left")
        .select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), "named")
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, fanout: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs (doc_id, text, source; others are ignored).

    size is the number of blank-separated words (null text: 0). A null source is
    a source of its own. Documents of size 0 are never taken. Rows that repeat an
    id, or have none, get copies of their own. An empty table gives an empty result.
    """
    return mix_rows(docs, weights, share, cap, fanout, seed).drop("named")
