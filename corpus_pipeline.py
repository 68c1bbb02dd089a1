"""From raw documents to shards of a training mix, in five stages.

Each stage takes the documents its predecessor kept, and all but the last return
rows of the same columns. Rows whose doc_id is null can't be told apart and are
kept by the filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreframe.llm import decontamination, jaccard, mixing, quality, sharding
from oreframe.llm._spark import checkpointed, table


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    return docs.join(out.select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return _without(docs, quality.classify_quality(docs, table(spark, sf_dir, "labels")).where("not keep"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; repeated rows count as copies."""
    found = jaccard.jaccard_components(docs)
    known = docs.where("doc_id is not null")
    kept = _without(known, found.where("component_id <> doc_id")).dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return _without(docs, decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Ids are unique by now; rows without one are numbered, and joined by that number.
    """
    unnamed = checkpointed(docs.where("doc_id is null").withColumn("_row", F.monotonically_increasing_id()))
    named = docs.where("doc_id is not null").withColumn("_row", F.lit(None).cast("long"))
    copies = checkpointed(mixing.mix_rows(named.unionByName(unnamed), name="_row").where("copies > 0").select("doc_id", "named", "copies"))
    by_id = copies.where("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    by_row = copies.where("doc_id is null").select(F.col("named").alias("_row"), "copies")
    taken = named.join(by_id, "doc_id").unionByName(unnamed.join(by_row, "_row"))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).drop("_copy")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of the mix."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: No stage but decontamination has an equal in SQL; tests hold each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
