"""Filings as a stream of files: each is taken once, and late ones need nothing more, as facts are ordered by date when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import state
from ..sources.keyed import KeyedTable

REGISTRY = "key string, parse_status string, parse_error string"


def new_filings(spark: SparkSession, folder: str, schema: StructType | str, keep: str = "30 days") -> DataFrame:
    """A stream of the filings in JSON files of folder (ticker, url, announced_at, ...), each key once.

    Keys are kept for as long as the watermark, so a filing that comes again later
    than that counts once more; registration against the table settles it.
    """
    rows = spark.readStream.schema(schema).json(folder)
    return rows.withColumn("key", state.content_key(F.col("ticker"), F.col("url"))).withWatermark("announced_at", keep).dropDuplicatesWithinWatermark(["key"])


def registry(spark: SparkSession, path: str, buckets: int = 64) -> KeyedTable:
    """The table of registered filings: key, parse_status, parse_error."""
    return KeyedTable(spark, path, ["key"], buckets)


def register_stream(filings: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Registers what the folder holds now in the registry at path and ends. A batch rewrites only the buckets of its keys, and may be repeated."""

    def register(batch: DataFrame, number: int) -> None:
        def settle(have: DataFrame | None, new: DataFrame) -> DataFrame:
            have = have if have is not None else new.sparkSession.createDataFrame([], REGISTRY)
            return state.register_documents(have, new).drop("is_new")

        registry(batch.sparkSession, path, buckets).merge(batch, settle)

    return filings.writeStream.foreachBatch(register).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
