"""Fact tables that lie together: written once in buckets of their key, so that joins and aggregates by it need no shuffle.

Two tables of the same key and number of buckets join bucket by bucket. A bucket is one
file, sorted by the key; the number of buckets is what a table should grow by (a bucket
should stay under a few hundred MB). By default it is the number of shuffle partitions, and
more where the sources are large (BUCKET bytes of them each), as a task sorts a bucket.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = 16 << 20
_LOADED: dict[tuple[str, str, str], tuple[tuple, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets one of its own; on a cluster that is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if folder is None:
        if ("", context.applicationId, "") not in _LOADED:
            _LOADED["", context.applicationId, ""] = (), tempfile.mkdtemp(prefix="spark-facts-")
        folder = _LOADED["", context.applicationId, ""][1]
    return folder.rstrip("/")


def write_facts(rows: DataFrame, key: str, buckets: int | None = None, folder_by: str | None = None, dealt: bool = False) -> str:
    """The name of a new table of rows, bucketed and sorted by key, with a folder for each value of folder_by. dealt: rows lie in that many parts by key already."""
    spark = rows.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"facts_{uuid.uuid4().hex}"
    write = (rows if dealt else rows.repartition(n, key)).write.bucketBy(n, key).sortBy(key)
    write = write.partitionBy(folder_by) if folder_by else write
    write.format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return name


def _state(spark: SparkSession, paths: list[str]) -> tuple:
    """One row that changes when a file under paths comes, goes, or changes its size or time; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max(F.unix_micros("modificationTime")), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first())


def _parts(spark: SparkSession, state: tuple) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), (state[1] or 0) // BUCKET)


def parts(spark: SparkSession, sources: list[str]) -> int:
    """The number of buckets of a table over the files of sources."""
    return _parts(spark, _state(spark, sources))


def loaded(spark: SparkSession, name: str, sources: list[str], key: str, rows: Callable[[], DataFrame], buckets: int | None = None, folder_by: str | None = None, dealt: bool = False) -> DataFrame:
    """The fact table of that name over the files of sources: written when first asked for, and again when a file of theirs has changed; else the one written before in this application."""
    place = spark.sparkContext.applicationId, name, "\n".join(sources)
    state = _state(spark, sources)
    old = _LOADED.get(place)
    if old is None or old[0] != state or not spark.catalog.tableExists(old[1]):
        _LOADED[place] = state, write_facts(rows(), key, buckets or _parts(spark, state), folder_by, dealt)
        if old:
            spark.sql(f"drop table if exists {old[1]}")
    return spark.table(_LOADED[place][1])
