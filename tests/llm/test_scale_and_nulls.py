"""Exchanges of several parts a task, hot keys, null ids, and quality of the fitted operators on held-out rows."""

import zlib

import numpy as np
import pytest
from oreframe.llm import _exchange, decontamination, graph, jaccard, licenses, neighbours, quality, sharding, substring_dedup, suffix_dedup, toxicity
from oreframe.llm._spark import join_hot

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.1"


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("run", [
    lambda d: substring_dedup.remove_repeats(d, 5), lambda d: suffix_dedup.remove_repeated_bytes(d, 30), lambda d: jaccard.jaccard_components(d),
])
def test_several_parts_a_task(docs, monkeypatch, run):
    monkeypatch.setattr(_exchange, "parts_of", lambda d: 3)
    few = rows_of(run(docs))
    monkeypatch.setattr(_exchange, "parts_of", lambda d: 23)
    monkeypatch.setattr(_exchange, "MAX_TASKS", 2)
    assert rows_of(run(docs)) == few


def test_hot_keys(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).cast("long").alias("k"), "id")
    small = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).union(spark.createDataFrame([(7, 1)], "k long, x long"))
    for how in ("inner", "left"):
        assert rows_of(join_hot(big, small, "k", how)) == rows_of(big.join(small, "k", how))
    edges = [(0, i) for i in range(1, 1500)] + [(i, i + 1) for i in range(2000, 2300)]
    got = {r.v: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1500)} == {0} and {got[i] for i in range(2000, 2301)} == {2000}


def test_null_ids(docs):
    nameless = docs.where("doc_id in (5, 7)").withColumn("doc_id", F.lit(None).cast("long"))
    table = docs.unionByName(nameless)
    bench = docs.where("doc_id < 4").select(F.col("doc_id").alias("item_id"), "text")
    for run in (
        lambda d: licenses.scan_licenses(d), lambda d: decontamination.find_contamination(d, bench), lambda d: decontamination.find_contamination(d, bench, block_bytes=300),
        lambda d: substring_dedup.remove_repeats(d), lambda d: sharding.assign_shards(d).select("doc_id", "size"),
    ):
        out = run(table)
        assert out.where("doc_id is null").count() == 2 and rows_of(out.where("doc_id is not null")) == rows_of(run(docs))
    out = suffix_dedup.remove_repeated_bytes(table, 30)
    assert out.where("doc_id is null").count() == 2 and out.count() == docs.count() + 2
    got = jaccard.jaccard_components(table)
    assert got.where("doc_id is null").count() == 2
    assert rows_of(got.where("doc_id is not null")) == rows_of(jaccard.jaccard_components(docs))


def test_templates_table(spark, docs):
    table = spark.createDataFrame([*licenses.TEMPLATES, ("none", None), ("none", " - ")], "label string, text string")
    assert rows_of(licenses.scan_licenses(docs, table)) == rows_of(licenses.scan_licenses(docs))


def test_neighbours_of_a_table(spark):
    """Recall against brute force over all queries of the table; scores are exact."""
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in v.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    found = total = 0
    for r in neighbours.nearest_neighbours(v, v.where("vec_id % 100 = 0")).groupBy("query_id").agg(F.collect_list("vec_id").alias("a"), F.collect_list("score").alias("s")).collect():
        d = np.sqrt(((m - x[r.query_id]) ** 2).sum(1))
        true = [i for i in ids[np.lexsort((ids, d))] if i != r.query_id][:10]
        found, total = found + len(set(true) & set(r.a)), total + 10
        assert all(s == pytest.approx(d[np.searchsorted(ids, i)], abs=1e-12) for i, s in zip(r.a, r.s, strict=True))
    assert total == 10 * sum(i % 100 == 0 for i in ids) and found >= 0.9 * total


def auc(y, s):
    a, b = [x for x, t in zip(s, y, strict=True) if t], [x for x, t in zip(s, y, strict=True) if not t]
    return np.mean([(x > z) + 0.5 * (x == z) for x in a for z in b])


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_rows(spark):
    """Both classifiers on rows of the table whose labels they haven't seen."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect() if held(r.doc_id)}
    s = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).where("held_out").collect() if r.doc_id in truth and truth[r.doc_id].toxic is not None}
    assert len(s) > 1000 and auc([truth[i].toxic for i in s], list(s.values())) > 0.88
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    q = {r.doc_id: r for r in quality.classify_quality(docs, seen).collect() if r.doc_id in truth and truth[r.doc_id].quality is not None}
    assert auc([truth[i].quality for i in q], [r.score for r in q.values()]) > 0.9
    right = np.mean([r.keep == bool(truth[i].quality) for i, r in q.items()])
    kept = np.mean([r.keep for i, r in q.items() if truth[i].quality])
    print("quality: accuracy", right, "good kept", kept)
    assert right > 0.85 and kept > 0.9
