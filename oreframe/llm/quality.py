"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on features of the text, fitted on a bounded sample of
labelled rows, gives each document a probability. Sites (hosts, and paths in
them) have good shares: a path's is shrunk towards its host's, a host's towards
the global one, with strengths estimated from the spread between sites. A
document's log odds move by those of its path over the global ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import checkpointed, in_tasks
from .logistic import fit_logistic

#: Bound of the sample of labelled rows that the classifier is fitted on.
TRAINING_ROWS = 20_000

_UPPER, _DIGIT, _SIGN = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[0x41:0x5B] = 1
_DIGIT[0x30:0x3A] = 1
_SIGN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,'-"]] = 1


def features(texts: pa.Array) -> np.ndarray:
    """A row of shape features for each text."""
    words = tx.split(texts, tx.BLANK_SEPARATED)
    data, starts = words.data, words.text_starts
    size = np.maximum(np.diff(starts) - 1, 1).astype(float)
    n = np.maximum(words.counts, 1).astype(float)
    per = lambda table: np.add.reduceat(table[data], starts[:-1]) / size if len(texts) else np.zeros(0)
    h, doc = words.hashes(), words.doc
    if len(h):
        pair = tx.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = tx.groups(pair[(o := tx.order(pair))])[0]
        distinct = np.bincount(doc[o[first]], minlength=len(texts))
    else:
        distinct = np.zeros(len(texts))
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
    length = np.bincount(doc, words.ends - words.starts, len(texts)) / n
    ends_sign = np.bincount(doc, _SIGN[data[words.ends - 1]], len(texts)) / n if len(h) else np.zeros(len(texts))
    lone = np.bincount(doc, (words.ends - words.starts == 1) * _SIGN[data[words.starts]], len(texts)) / n if len(h) else np.zeros(len(texts))
    upper, digit, sign = per(_UPPER), per(_DIGIT), per(_SIGN)
    variety = distinct / n
    # against what a text of that many words has, as variety falls with length
    return np.stack([upper, digit, sign, np.minimum(sign * 10, 1), variety, variety * np.log1p(n), again / n, np.minimum(length, 40) / 10, ends_sign, lone, np.log1p(n), np.log1p(n) ** 2 / 10], 1)


def _map(name: str, f: Callable, kind: pa.DataType, keep: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches, limit=tx.HASH_BYTES):  # features are tables as long as the text
            yield pa.record_batch([*(batch.column(i + 1) for i in range(keep)), pa.array(list(f(batch.column(0))), kind)], [*batch.schema.names[1:], name])

    return run


def fit(docs: DataFrame, labels: DataFrame, training: int = TRAINING_ROWS) -> np.ndarray:
    """Weights from at most `training` labelled rows, chosen by a hash of their ids; an id with labels of both kinds counts as good."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # training rows of 12 bytes
    rows = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).select("text", "quality")  # of several texts of an id the smallest
    seen = rows.mapInArrow(in_tasks(_map("x", features, pa.list_(pa.float64()), 1)), "quality int, x array<double>").toPandas()
    width = features(pa.array(["a"])).shape[1]
    y = seen["quality"].to_numpy()
    if not len(y) or y.min() == y.max():
        prior = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(width), math.log(prior / (1 - prior)))
    return fit_logistic(np.stack(seen["x"]), y, penalty=0.1)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior rows of a beta prior on the groups' shares, by the method of moments."""
    n, s = F.col("n"), F.col("good") / F.col("n")
    r = groups.agg(
        F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(n * F.pow(s - mean, 2)).alias("between"), F.sum(n * mean * (1 - mean)).alias("unit"), F.sum(n * n).alias("squares"),
    ).first()
    if not r["n"] or r["k"] < 2 or not r["unit"]:
        return 10.0
    share = r["unit"] / r["n"]
    spread = (r["between"] - (r["k"] - 1) * share) / max(r["n"] - r["squares"] / r["n"], 1e-9)
    return float(min(1e6, max(1.0, share / spread - 1))) if spread > 0 else 1e6


def classify_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, training: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, text_score, host_share, site_share, score, keep for each row of docs (doc_id, text and the columns host and path; others are ignored).

    Site shares average what the classifier says of a site's rows, not labels. Each row is judged by itself,
    whether its id repeats or is null. Null hosts and paths are sites of their own. Null and empty texts are scored
    by their (empty) features. Without labels of both classes text_score is their
    share for all (one half without labels). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    weights = spark.sparkContext.broadcast(fit(docs, labels, training))

    def probability(texts: pa.Array) -> np.ndarray:
        w = weights.value
        return 1 / (1 + np.exp(-np.clip(features(texts) @ w[:-1] + w[-1], -12, 12)))

    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    rows = checkpointed(texts.mapInArrow(in_tasks(_map("p", probability, pa.float64(), 3)), "doc_id long, host string, path string, p double"))
    paths = checkpointed(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("good") / F.sum("n")).first()[0] or 0.5
    mean = min(1 - 1e-6, max(1e-6, total))
    a = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("good") + a * mean) / (F.col("n") + a)).alias("host_share"))
    paths = checkpointed(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))))
    b = _strength(paths, F.col("host_share"))
    paths = paths.select("h", F.col("path").alias("q"), "host_share", ((F.col("good") + b * F.col("host_share")) / (F.col("n") + b)).alias("site_share"))
    odds = _logit(F.col("p")) + _logit(F.col("site_share")) - _logit(F.lit(mean))
    return (
        rows.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
        .withColumn("score", 1 / (1 + F.exp(-odds)))
        .select("doc_id", F.col("p").alias("text_score"), "host_share", "site_share", "score", (F.col("score") >= threshold).alias("keep"))
    )
