"""Shapes that many operators share."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def highest_before(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str) -> DataFrame:
    """df with `name`: the greatest value (a struct, say) of the rows of the same keys that come before by order; null for the first.

    A struct that begins with the columns of order gives the row just before. No key is
    one task: block, which mustn't fall as order rises, cuts a key's rows into blocks. Windows run over the
    rows of a block and over the greatest values of a key's blocks (a row for each).
    """
    d = df.withColumns({"_block": block, "_value": value})
    inside = F.max("_value").over(W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    tops = d.groupBy(*keys, "_block").agg(F.max("_value").alias("_top"))
    earlier = F.max("_top").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    on = [*keys, "_block"]
    tops = tops.withColumn("_earlier", earlier).select(*[F.col(c).alias(f"_of{c}") for c in on], "_earlier")
    d = d.withColumn("_inside", inside)
    d = d.join(tops, reduce(and_, [d[c].eqNullSafe(tops[f"_of{c}"]) for c in on]))
    return d.withColumn(name, F.greatest("_inside", "_earlier")).drop("_block", "_value", "_inside", "_earlier", *[f"_of{c}" for c in on])


def reasons(*conditions: Column) -> Column:
    """Those of the given texts that aren't null, joined."""
    return F.array_join(F.array_compact(F.array(*conditions)), "; ")
