"""Readers of registry extracts and of feed payloads (JSON as a column), and of small lookup files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that releases of the registries give to the same field; the first that isn't empty counts.
ALIASES = {
    "deposit_name": ("deposit_name", "DEPOSIT_NAME", "name", "Name", "PROJECT_NAME"),
    "operator_name": ("operator_name", "holder_name", "tenement_holder", "OPERATOR", "operator", "Operator"),
    "commodities": ("commodities", "commodity", "COMMODITIES", "Commodities", "COMMODITY"),
    "state": ("state", "STATE"),
    "operating_status": ("operating_status", "OPERATING_STATUS", "mining_status", "Status"),
}
FEATURES = "struct<features:array<struct<properties:map<string,string>>>>"
CHART = "struct<chart:struct<result:array<struct<meta:struct<regularMarketPrice:double>,timestamp:array<bigint>,indicators:struct<quote:array<struct<close:array<double>>>>>>>>"
ITEMS = "struct<data:struct<items:array<struct<headline:string,documentKey:string,date:string>>>>"
DOCUMENTS = "https://documents/"


def deposit_fields(value) -> list[Column]:
    """A column for each field, of what value(alias) gives."""
    out = []
    for field, names in ALIASES.items():
        given = [c for c in map(value, names) if c is not None]
        out.append(F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in given], F.lit(""))).alias(field))
    return out


def deposits_from_geojson(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each feature of FeatureCollections."""
    rows = payloads.select(F.explode(F.from_json(payload, FEATURES)["features"]).alias("f"))
    return rows.select(*deposit_fields(lambda name: F.try_element_at("f.properties", F.lit(name))))


def read_deposits_geojson(spark: SparkSession, path: str) -> DataFrame:
    return deposits_from_geojson(spark.read.text(path, wholetext=True), "value")


def deposits_from_records(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a registry's table, whichever of the field's names it uses; names can differ in case alone. Columns of keep stay as they are."""
    own = {c.lstrip("﻿"): c for c in records.columns}
    return records.select(*deposit_fields(lambda name: F.col(f"`{own[name]}`") if name in own else None), *keep)


def read_deposits_csv(spark: SparkSession, path: str) -> DataFrame:
    """A registry's CSV with a header line, with or without a byte order mark."""
    return deposits_from_records(spark.read.csv(path, header=True, multiLine=True, escape='"'))


def read_lookup_csv(spark: SparkSession, path: str, key: str, upper: tuple[str, ...] = ()) -> DataFrame:
    """A small table by a key in lower case; columns of upper are put in capitals."""
    df = spark.read.csv(path, header=True)
    return df.select(*[F.lower(F.trim(c)).alias(c) if c == key else F.upper(F.trim(c)).alias(c) if c in upper else F.trim(c).alias(c) for c in df.columns])


def tickers_of(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tickers of a list, one on a line; blank lines and those that begin with # are left out."""
    return lines.where((F.trim(column) != "") & ~F.col(column).startswith("#")).select(F.trim(column).alias("ticker"))


def read_ticker_list(spark: SparkSession, path: str) -> DataFrame:
    return tickers_of(spark.read.text(path))


def price_series(payloads: DataFrame, *keys: str) -> DataFrame:
    """(keys, date, close) of chart payloads; points without a close are left out."""
    r = payloads.select(*keys, F.get(F.from_json("payload", CHART)["chart"]["result"], F.lit(0)).alias("r"))
    close = F.get(F.col("r.indicators.quote"), F.lit(0))["close"]
    r = r.select(*keys, F.explode(F.arrays_zip(F.col("r.timestamp").alias("ts"), close.alias("close"))).alias("x"))
    return r.where("x.close is not null and x.ts is not null").select(*keys, F.to_date(F.timestamp_seconds("x.ts")).alias("date"), F.col("x.close").alias("close"))


def latest_quotes(payloads: DataFrame, *keys: str) -> DataFrame:
    """(keys, price, error) of quote payloads: one row each, with why there is no price."""
    result = F.from_json("payload", CHART)["chart"]["result"]
    price = F.get(result, F.lit(0))["meta"]["regularMarketPrice"]
    empty = F.coalesce(F.size(result) <= 0, F.lit(True)) | result.isNull()
    return payloads.select(*keys, price.alias("price"), F.when(empty, "empty_result").when(price.isNull(), "no_price").alias("error"))


def announcement_items(payloads: DataFrame, *keys: str) -> DataFrame:
    """(keys, header, url, document_date) of feed payloads."""
    rows = payloads.select(*keys, F.explode(F.from_json("payload", ITEMS)["data"]["items"]).alias("i"))
    return rows.select(*keys, F.col("i.headline").alias("header"), F.concat(F.lit(DOCUMENTS), F.col("i.documentKey")).alias("url"), F.substring("i.date", 1, 10).alias("document_date"))
