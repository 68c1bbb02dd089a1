"""A table with one row for each key, of which a write replaces only what it touches.

Rows lie in buckets of their key's hash, and a bucket has two slots. A write reads the
buckets that its rows fall into, puts their next state into the free slots (dynamic partition
overwrite) and then names the slots in use in a new version of the manifest, one small
file. Until that file is there readers see the table as it was, so a write that ends midway
leaves nothing behind but a free slot, which the next write replaces.

There must be one writer at a time. A reader should be done before the second write after it begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import top


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.data, self.manifest = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/manifest"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _state(self) -> tuple[int, dict[int, int]]:
        """(version, slot in use of each bucket); at most a row for each bucket."""
        try:
            rows = self.spark.read.schema("version long, buckets int, bucket int, slot int, _side int").parquet(self.manifest)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        newest = rows.agg(F.max("version")).scalar()
        found = rows.where(F.col("version") == newest).collect()
        if not found:
            return 0, {}
        if found[0].buckets != self.buckets:
            raise ValueError(f"the table has {found[0].buckets} buckets, not {self.buckets}")
        return found[0].version, {r.bucket: r.slot for r in found}

    def _rows(self, slots: dict[int, int]) -> DataFrame | None:
        if not slots:
            return None
        paths = [f"{self.data}/_bucket={b}/_slot={s}" for b, s in sorted(slots.items())]
        return self.spark.read.option("basePath", self.data).option("mergeSchema", "true").parquet(*paths).drop("_bucket", "_slot")

    def read(self) -> DataFrame | None:
        """The table as the last whole write left it; None before the first one."""
        return self._rows(self._state()[1])

    def merge(self, incoming: DataFrame, settle: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        """Replaces the buckets that incoming's keys fall into by settle(their rows, incoming), which must keep to these keys. Without such rows it is given None."""
        incoming = incoming.persist()
        try:
            version, slots = self._state()
            touched = [r[0] for r in incoming.select(self._bucket()).distinct().collect()]  # a row for each bucket at most
            if not touched:
                return
            free = {b: 1 - slots[b] if b in slots else 0 for b in touched}
            rows = settle(self._rows({b: slots[b] for b in touched if b in slots}), incoming)
            slot = self.spark.createDataFrame(list(free.items()), "_bucket int, _slot int")
            placed = rows.withColumn("_bucket", self._bucket()).join(F.broadcast(slot), "_bucket")
            placed.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_slot").parquet(self.data)
            self._commit(version + 1, slots | free)
        finally:
            incoming.unpersist()

    def _commit(self, version: int, slots: dict[int, int]) -> None:
        rows = self.spark.createDataFrame([(version, self.buckets, b, s, version % 2) for b, s in slots.items()], "version long, buckets int, bucket int, slot int, _side int")
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_side").parquet(self.manifest)

    def upsert(self, rows: DataFrame, order: list[Column]) -> None:
        """Keeps the first row of each key, in the given order, of the table's and the new ones."""
        self.merge(rows, lambda have, new: top(new if have is None else have.unionByName(new, allowMissingColumns=True), self.keys, order))
