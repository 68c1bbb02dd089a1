"""Toxicity, quality, neighbours and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from oreframe.llm import neighbours, quality, toxicity

from pyspark.sql import functions as F


DATA = "/root/testdata/sf0.1"


def auc(y, s):
    a, b = [x for x, t in zip(s, y, strict=True) if t], [x for x, t in zip(s, y, strict=True) if not t]
    return np.mean([(x > z) + 0.5 * (x == z) for x in a for z in b])


@pytest.fixture(scope="module")
def labelled(spark):
    """Ordinary prose, some with rude words, some of shouting or signs."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7)))
    rude = [word() + "x" + word() for _ in range(8)]
    docs, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(20, 120))]
        toxic, bad = i % 4 == 0, i % 5 == 0
        for _ in range(5 if toxic else 0):
            w[r.randrange(len(w))] = r.choice(rude)
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + "%%%" for x in w]
        docs.append((i, " ".join(w), "en", f"s{i % 7}", "clash"))
        labels.append((i, int(not bad), int(toxic), "clash"))
    docs += [(1000, None, None, None, "x"), (1001, "", "en", None, "x"), (1002, "a", None, "s0", "x"), (None, "null id", "en", "s1", "x"), docs[5]]
    labels += [(5000, 1, 1, "x"), (None, 0, 1, "x"), (3, None, None, "x")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, p string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"),
    )


def test_toxicity(labelled, no_docs):
    docs, labels = labelled
    got = toxicity.score_toxicity(docs, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert auc([truth[r["doc_id"]] for r in held], [r["score"] for r in held]) > 0.95
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in got)
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0}


@pytest.mark.parametrize("toxic", [299, 301, 1500])
def test_toxic_phrases_by_one_rule(spark, toxic):
    """A word of 10 toxic rows only is a phrase on both sides of 300 toxic rows; one that is a little more frequent in them never is."""
    rows = [(1, f"plain common{' slight' if i % 5 < 2 else ''} {'rare' if i < 10 else 'worda'}") for i in range(toxic)]
    rows += [(0, f"plain common{' slight' if i % 10 < 3 else ''} wordb") for i in range(6 * toxic)]
    found = b"".join(toxicity._phrases(spark.createDataFrame(rows, "toxic int, text string"))).split()
    assert b"rare" in found and not {b"plain", b"common", b"slight", b"wordb"} & set(found)


def test_quality(spark, labelled, no_docs):
    docs, labels = labelled
    out = quality.classify_quality(docs, labels)
    got = out.collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    known = [r for r in got if r["doc_id"] in truth and r["doc_id"] is not None]
    assert np.mean([r["keep"] == bool(truth[r["doc_id"]]) for r in known]) > 0.98
    # the same shrinkage in plain Python
    rows = [(r["doc_id"], r["text_score"], r["host_share"], r["site_share"], r["score"]) for r in got]
    place = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.collect()}
    mean = np.mean([p for _, p, *_ in rows])
    logit = lambda p: np.log(p / (1 - p))
    by_host, by_path = Counter(), Counter()
    for d, p, *_ in rows:
        by_host[place[d][0]] += p
        by_path[place[d]] += p
    for d, p, host, site, score in rows:
        assert score == pytest.approx(1 / (1 + np.exp(-(logit(p) + logit(site) - logit(mean)))))
        n, s = sum(place[x[0]][0] == place[d][0] for x in rows), by_host[place[d][0]]
        assert min(s / n, mean) - 1e-9 <= host <= max(s / n, mean) + 1e-9
        n, s = sum(place[x[0]] == place[d] for x in rows), by_path[place[d]]
        assert min(s / n, host) - 1e-9 <= site <= max(s / n, host) + 1e-9
    assert quality.classify_quality(no_docs, labels).count() == 0
    assert quality.classify_quality(docs, labels.limit(0)).count() == docs.count()


def test_perturbations():
    for m in (1, 2, 4):
        sets = neighbours.perturbations(m, 1000)
        assert len(sets) == len(set(sets)) == 3**m and sets[0] == ()


def test_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 12)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(2000, None, 1), (2100, [0.0] * 12, 1), (2200, [float("nan")] * 12, 1), (2300, [None, *[1.0] * 11], 1), (2400, [1.0], 1), (2500, [float("inf")] * 12, 1), (None, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int").repartition(3)
    got = {}
    for a in neighbours.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(a["query_id"], {})[a["rank"]] = (a["vec_id"], a["score"])
    assert sorted(got) == list(range(0, 1500, 100))
    found = 0
    for q, ranks in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        true = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert sorted(ranks) == list(range(1, 11)) and all(s == pytest.approx(d[v]) for v, s in ranks.values())
        assert [ranks[k] for k in range(1, 11)] == sorted(ranks.values(), key=lambda y: (y[1], y[0]))
        found += len(set(true) & {v for v, _ in ranks.values()})
        if 100 <= q < 400:
            assert [ranks[k][0] for k in range(1, 11)] == true
    assert found >= 0.9 * 10 * len(got)
    few = df.where("vec_id < 4 or vec_id = 100").select("vec_id", "embedding")
    assert neighbours.nearest_neighbours(few, few).groupBy("query_id").count().where("count = 4").count() == 5
    assert neighbours.nearest_neighbours(few.limit(0), few.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, docs, labelled):
    import corpus_pipeline

    extra, labels = labelled
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    table = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(extra.where("doc_id >= 0").select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang", "source", F.length("text").cast("long").alias("n_chars")))
    copied = table.where("doc_id = 10033 or doc_id = 10041").withColumn("doc_id", F.col("doc_id") + 50_000)
    table = table.unionByName(copied)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("doc_id", F.col("doc_id") + 10_000).write.parquet(f"{tmp_path}/labels.parquet")
    taken = table.where("doc_id = 10043").select(F.lit(1).cast("long").alias("item_id"), "text")
    taken.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [c for c in base.columns] == table.columns
    seen = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/out{k}"))
    ids = [[r[0] for r in s.select("doc_id").collect()] for s in seen]
    assert all(s.schema == seen[0].schema for s in seen[1:-1])
    assert not any(10_000 <= i < 10_900 and i % 5 == 0 for i in ids[1])
    assert {60033, 60041} <= set(ids[1]) and not {60033, 60041} & set(ids[2]) and {10033, 10041} <= set(ids[2])
    assert set(ids[2]) - set(ids[3]) == {10043}
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) == 2
    assert Counter(ids[5]) == Counter(ids[4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids[5])


def test_stages_without_rows_or_ids(spark, tmp_path, docs, labelled):
    """Filters keep rows without an id as they are, the mix takes each by itself, and an empty table passes through."""
    import corpus_pipeline

    extra, labels = labelled
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    table = docs.where("length(text) > 20").select(*columns).withColumn("clash", F.lit("x"))
    nameless = table.where("doc_id < 30").withColumn("doc_id", F.lit(None).cast("long"))
    labels.where("doc_id < 900").withColumn("doc_id", F.col("doc_id") + 10_000).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of these words stand anywhere in the table of documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    n = nameless.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, nameless.unionByName(table), str(tmp_path))
        assert out.columns == table.columns and out.where("doc_id is null").count() == n, name
    mixed = corpus_pipeline.mixing_stage(spark, nameless, str(tmp_path))
    sizes = [len(r.text.split()) for r in nameless.collect()]
    assert mixed.columns == table.columns and n <= mixed.count() <= 2 * n
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * sum(sizes)) <= 5 * max(sizes)
    assert corpus_pipeline.sharding_stage(spark, mixed, str(tmp_path)).count() == mixed.count()


def test_queries_exist():
    from oreframe.llm.queries import QUERIES

    assert [x.split("_")[0] for x in QUERIES] == [f"op{n}" for n in range(1, 14)]
