"""Small helpers around the session."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder named in spark.checkpoint.dir, its lineage cut. Where that is unset a local session gets a folder of its own; on a cluster it is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_tasks(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, giving freed memory back to the system at its end: Python workers stay alive between tasks, and keep it otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return run


#: A key is hot when it holds more than this share of the rows; so at most HOT_KEYS keys are.
HOT_KEYS = 1_000


def join_hot(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined with small, which has a row for each key at most, where a key may hold a third of big.

    Keys that hold over a thousandth of big's rows are at most a thousand, whatever the size: their rows
    of small are broadcast. The rest is a merge join. big is read three times, so it should be a written table.
    """
    least = big.count() / HOT_KEYS
    hot = checkpointed(big.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > least).select(key))
    few = F.broadcast(hot)
    rest = big.join(few, key, "left_anti").join(small.hint("merge"), key, how)
    return big.join(few, key, "left_semi").join(F.broadcast(small.join(few, key, "left_semi")), key, how).unionByName(rest)
