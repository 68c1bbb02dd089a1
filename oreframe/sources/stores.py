"""Sinks: staging tables that a later run replaces, and facts that are only appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.common import top
from .keyed import KeyedTable


def latest_staging(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return top(rows, keys, order)


def write_staging(rows: DataFrame, path: str, keys: list[str], order: list[Column], buckets: int = 64) -> None:
    """Replaces the rows of rows' keys in the table at path by the newest of each key. Only the buckets of these keys are written, and a write that fails changes nothing."""
    KeyedTable(rows.sparkSession, path, keys, buckets).upsert(rows, order)


def read_staging(spark: SparkSession, path: str, keys: list[str], buckets: int = 64) -> DataFrame | None:
    return KeyedTable(spark, path, keys, buckets).read()


def write_counted(rows: DataFrame, write: Callable[[DataFrame], None], **counts: Column) -> dict[str, int]:
    """What write(rows) wrote, counted by the aggregates given while it was written, without a second pass.

    write must write the rows as they come: behind a shuffle of its own, tasks that run again would count twice.
    """
    seen = Observation()
    write(rows.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return {name: seen.get[name] for name in counts}


def write_sweep(gated: DataFrame, path: str) -> dict[str, int]:
    """Outcomes (study_id, reason) of a sweep of gated studies, written to path, and its counts: every refusal is an error."""
    ok = F.col("reason").isNull()
    return write_counted(gated.select("study_id", "reason"), lambda d: d.write.mode("errorifexists").parquet(path), total=F.count("*"), refreshed=F.count_if(ok), errors=F.count_if(~ok))


def new_snapshots(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of documents that have none in existing."""
    return rows.join(existing.select("document_id"), "document_id", "left_anti")


def append_snapshots(rows: DataFrame, existing: DataFrame, path: str, date: str = "effective_date") -> int:
    """Appends rows of documents that aren't in existing, in a folder for each year; how many these are."""
    new = new_snapshots(rows, existing).withColumn("year", F.year(date))
    return write_counted(new, lambda d: d.write.mode("append").partitionBy("year").parquet(path), added=F.count("*"))["added"]
