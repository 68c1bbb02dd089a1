"""Quotes and price series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_price(prices: DataFrame, as_of: Column, ttl_hours: int | None = None) -> DataFrame:
    """The newest quote of each commodity by as_of, none older than ttl_hours. One aggregation with map-side combine, so a hot commodity costs a row per task."""
    fresh = prices.where(F.col("fetched_at") <= as_of)
    if ttl_hours is not None:
        fresh = fresh.where(F.col("fetched_at") >= as_of - F.make_interval(hours=F.lit(ttl_hours)))
    newest = F.max_by(F.struct("price_usd", "price_id", "fetched_at"), F.struct("fetched_at", "price_id"))
    return fresh.groupBy("commodity").agg(newest.alias("q")).select("commodity", "q.price_usd", "q.price_id", "q.fetched_at")


# Quote symbols with the metal that they price, its unit and the multiplier to it.
SYMBOLS = {
    "GC=F": ("Au", "USD/oz", 1.0), "SI=F": ("Ag", "USD/oz", 1.0), "HG=F": ("Cu", "USD/lb", 1.0), "PA=F": ("Pd", "USD/oz", 1.0), "PL=F": ("Pt", "USD/oz", 1.0), "UX=F": ("U3O8", "USD/lb", 1.0), "AUDUSD=X": ("AUDUSD", "USD_per_AUD", 1.0),
}
# Days of each range, and whether it is shown by week.
RANGES = {"6m": (182, False), "1y": (365, False), "3y": (3 * 365, True), "5y": (5 * 365, True), "max": (30 * 365, True)}


def symbol_map(quotes: DataFrame) -> DataFrame:
    """quotes(symbol, price, ...) with commodity, unit and price_usd; unknown symbols get an error and no price."""
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(*[F.lit(v) for v in x]) for kv in SYMBOLS.items() for x in kv])
    d = quotes.withColumn("_m", F.try_element_at(known, F.col("symbol")))
    return d.withColumns({
        "commodity": F.col("_m.col1"), "unit": F.col("_m.col2"), "price_usd": F.col("price") * F.col("_m.col3"), "error": F.when(F.col("_m").isNull(), F.concat(F.lit("no_commodity_for_symbol:"), "symbol")),
    }).drop("_m")


def asof_align(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str, bucket: str = "day") -> DataFrame:
    """left, with the last value of right at or before its time; rows before right's first are dropped.

    Times are cut into buckets, so that a long series is no single task: a bucket
    holds its rows, and begins with the last value of the buckets before, of which
    each key has one row a bucket.
    """
    at = F.date_trunc(bucket, on)
    both = left.withColumns({"_v": F.lit(None).cast(dict(right.dtypes)[value]), "_own": F.lit(1)}).unionByName(
        right.select(*keys, on, F.col(value).alias("_v")).withColumn("_own", F.lit(0)), allowMissingColumns=True
    ).withColumn("_bucket", at)
    last = right.groupBy(*keys, at.alias("_bucket")).agg(F.max_by(value, on).alias("_last"))
    spans = both.select(*keys, "_bucket").distinct().join(last, [*keys, "_bucket"], "left")
    carried = F.last("_last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select(*keys, "_bucket", carried.alias("_before"))
    within = F.last("_v", ignorenulls=True).over(W.partitionBy(*keys, "_bucket").orderBy(on, "_own").rowsBetween(W.unboundedPreceding, 0))
    d = both.join(spans, [*keys, "_bucket"]).withColumn(value, F.coalesce(within, "_before"))
    return d.where((F.col("_own") == 1) & F.col(value).isNotNull()).drop("_v", "_own", "_bucket", "_before")


def daily_close(prices: DataFrame) -> DataFrame:
    return prices.groupBy("commodity", F.to_date("fetched_at").alias("day")).agg(F.max_by("price_usd", F.struct("fetched_at", "price_id")).alias("close"))


def weekly(series: DataFrame) -> DataFrame:
    """The last close of each week; weeks begin on Monday."""
    return series.groupBy("commodity", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.max_by("close", "day").alias("close"))


def range_window(series: DataFrame, range_: str, as_of: Column) -> DataFrame:
    """Daily closes (commodity, day, close) of a range that ends at as_of; long ranges by week, under the week's first day. Unknown ranges count as 1y."""
    days, by_week = RANGES.get(range_, RANGES["1y"])
    d = series.where((F.col("day") > F.date_sub(as_of, days)) & (F.col("day") <= as_of))
    return weekly(d).withColumnRenamed("week", "day") if by_week else d


def rebase(series: DataFrame, base: float = 100.0) -> DataFrame:
    """Closes over each commodity's first, by an aggregate that is joined back (a row for each commodity)."""
    first = series.groupBy("commodity").agg(F.min_by("close", "day").alias("_first"))
    return series.join(first, "commodity").withColumn("rebased", F.col("close") / F.col("_first") * base).drop("_first")
