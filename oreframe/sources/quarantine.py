"""Readers that keep bad records: what can be used, and what can't with the reason and the record as it came.

A payload (a JSON document in a column) is rejected whole if it is no JSON or has nothing to read, else record by
record. Each function gives (good rows, rejects); rejects have the keys, place (the record's
index in its payload; null for the payload as a whole), reason and record.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import feeds

CORRUPT = "_corrupt"


class Checked(NamedTuple):
    good: DataFrame
    rejects: DataFrame


def _parsed(payloads: DataFrame, keys: tuple[str, ...], payload: str, kind: str) -> DataFrame:
    """keys, record and doc: the payload read permissively, with the text of what can't be read in doc's last field."""
    schema = f"{kind[:-1]},{CORRUPT}:string>"
    return payloads.select(*keys, F.col(payload).alias("record"), F.from_json(payload, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("doc"))


def _not_json() -> Column:
    return F.when(F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull(), "not_json")


def _whole(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.where("reason is not null").select(*keys, F.lit(None).cast("int").alias("place"), "reason", "record")


def _empty(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(-1)) <= 0


def _by_record(d: DataFrame, keys: tuple[str, ...], items: Column, reason: Column, good: list[Column]) -> Checked:
    """reason and good are of x, one of the items."""
    each = d.where("reason is null").select(*keys, F.posexplode(items).alias("place", "x")).withColumn("reason", reason)
    bad = each.where("reason is not null").select(*keys, "place", "reason", F.to_json("x").alias("record"))
    return Checked(each.where("reason is null").select(*keys, *good), _whole(d, keys).unionByName(bad))


def deposits_geojson(payloads: DataFrame, *keys: str, payload: str = "payload") -> Checked:
    """Features of FeatureCollections: not_json, no_features; no_properties, no_name."""
    d = _parsed(payloads, keys, payload, feeds.FEATURES)
    features = F.col("doc.features")
    d = d.withColumn("reason", F.coalesce(_not_json(), F.when(_empty(features), "no_features")))
    fields = feeds.deposit_fields(lambda name: F.try_element_at("x.properties", F.lit(name)))
    reason = F.when(F.col("x.properties").isNull(), "no_properties").when(fields[0] == "", "no_name")
    return _by_record(d, keys, features, reason, fields)


def price_charts(payloads: DataFrame, *keys: str, payload: str = "payload") -> Checked:
    """Points (date, close) of chart payloads: not_json, empty_result, no_timestamps, lengths_differ. Points without a close are gaps, not rejects."""
    d = _parsed(payloads, keys, payload, feeds.CHART)
    first = F.get(F.col("doc.chart.result"), F.lit(0))
    close = F.get(first["indicators"]["quote"], F.lit(0))["close"]
    reason = (
        F.when(_empty(F.col("doc.chart.result")), "empty_result").when(_empty(first["timestamp"]), "no_timestamps")
        .when(F.size(first["timestamp"]) != F.coalesce(F.size(close), F.lit(-1)), "lengths_differ")
    )
    d = d.withColumn("reason", F.coalesce(_not_json(), reason))
    return Checked(feeds.price_series(d.where("reason is null").select(*keys, F.col("record").alias("payload")), *keys), _whole(d, keys))


def announcements(payloads: DataFrame, *keys: str, payload: str = "payload") -> Checked:
    """Announcements of feed payloads: not_json, no_items; no_headline, no_key, bad_date."""
    d = _parsed(payloads, keys, payload, feeds.ITEMS)
    items = F.col("doc.data.items")
    d = d.withColumn("reason", F.coalesce(_not_json(), F.when(_empty(items), "no_items")))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    date = F.substring("x.date", 1, 10)
    reason = F.when(blank("x.headline"), "no_headline").when(blank("x.documentKey"), "no_key").when(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).isNull(), "bad_date")
    good = [F.col("x.headline").alias("header"), F.concat(F.lit(feeds.DOCUMENTS), F.col("x.documentKey")).alias("url"), date.alias("document_date")]
    return _by_record(d, keys, items, reason, good)


def deposit_records(records: DataFrame) -> Checked:
    """Deposits of a table of strings that was read permissively (its column _corrupt holds lines that don't fit the header): malformed, no_name."""
    marked = feeds.deposits_from_records(records, keep=(CORRUPT,)).withColumn("reason", F.when(F.col(CORRUPT).isNotNull(), "malformed").when(F.col("deposit_name") == "", "no_name"))
    fields = [c for c in marked.columns if c not in (CORRUPT, "reason")]
    told = F.coalesce(CORRUPT, F.to_json(F.struct(*fields)))
    return Checked(marked.where("reason is null").select(*fields), marked.where("reason is not null").select(F.lit(None).cast("int").alias("place"), "reason", told.alias("record")))


def read_deposits_csv(spark: SparkSession, path: str) -> Checked:
    """A registry's CSV with a header line; lines with too few or too many fields are rejects."""
    names = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, CORRUPT])
    return deposit_records(spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT))


def tally(feed: str, checked: Checked) -> DataFrame:
    """feed, reason (ok for good rows) and n."""
    good = checked.good.agg(F.count("*").alias("n")).select(F.lit(feed).alias("feed"), F.lit("ok").alias("reason"), "n")
    return good.unionByName(checked.rejects.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(feed).alias("feed"), "reason", "n"))
