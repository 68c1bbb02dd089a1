"""Ids that hold most rows, labels that contradict each other, and blocks of a benchmark, null items included."""

from collections import Counter

from oreframe.llm import decontamination, mixing, quality, toxicity

from pyspark.sql import functions as F


def test_mixing_an_id_of_many_rows(spark):
    n = 40_000
    hot = spark.range(n).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("a b"), F.repeat(F.lit(" c"), (F.col("id") % 3).cast("int"))).alias("text"), F.lit("s").alias("source"))
    rest = spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit("x y z").alias("text"), F.when(F.col("id") % 2 == 0, "s").otherwise("t").alias("source"))
    nameless = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words here").alias("text"), F.lit("u").alias("source"))
    docs = hot.unionByName(rest).unionByName(nameless)
    out = mixing.mix_sources(docs, fanout=8).groupBy("target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n"), F.max("copies").alias("most")).collect()
    assert sum(r.n for r in out) == n + 900
    assert all(abs(r.taken - r.target) <= 5 and r.most <= 2 for r in out)
    # no group of the tree holds the hot id's rows
    sizes = mixing.mix_rows(docs, fanout=8)
    assert sizes.count() == n + 900
    ordinary = rest.unionByName(nameless.limit(20))
    once, again = (sorted(map(str, mixing.mix_sources(x, fanout=8).collect())) for x in (ordinary, ordinary.repartition(7, "text")))
    assert once == again


def test_labels_that_contradict(spark):
    docs = spark.createDataFrame([(i, f"plain words of number {i}" + (" ÉXO bad" if i % 3 == 0 else "")) for i in range(300)] + [(7, "another text")] * 3, "doc_id long, text string")
    labels = [(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(300)] + [(i, 1, 1) for i in range(0, 300, 30)] + [(1, 1, 1), (2, 1, 1)]
    up = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    down = spark.createDataFrame(labels[::-1], "doc_id long, toxic int, quality int").repartition(5)
    for run in (lambda x: toxicity.score_toxicity(docs, x), lambda x: quality.classify_quality(docs.withColumns({"source": F.lit("s"), "lang": F.lit("l")}), x)):
        assert sorted(map(str, run(up).collect())) == sorted(map(str, run(down.dropDuplicates().unionByName(down)).collect()))
    rows = docs.join(up.dropDuplicates(["doc_id"]).select("doc_id", "toxic"), "doc_id")
    assert all(" éxo ".encode() not in p for p in toxicity._phrases(rows))  # windows lower A-Z alone


def test_blocks_of_a_benchmark(spark, docs):
    items = docs.where("doc_id < 12").select(F.col("doc_id").alias("item_id"), "text")
    nameless = docs.select(F.lit(None).cast("long").alias("item_id"), "text")
    table = items.unionByName(items.where("item_id = 3")).unionByName(nameless)
    one = [tuple(r) for r in decontamination.find_contamination(docs, items).collect()]
    for block_bytes in (200, 1000, 1 << 25):
        assert Counter(tuple(r) for r in decontamination.find_contamination(docs, table, block_bytes=block_bytes).collect()) == Counter(one)
