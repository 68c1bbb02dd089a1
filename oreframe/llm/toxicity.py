"""Toxicity by compression distance with zstandard dictionaries.

A dictionary is trained on ordinary text; others hold, besides, the toxic
phrases of the training rows, one dictionary for each tier of their z score: words whose document frequency is significantly
and much higher in toxic rows, by one rule at every size (a dictionary trained on whole toxic texts is mostly
ordinary text, and hardly tells them apart). All are padded with ordinary text
to one size. Windows of a few words are compressed under each; the bytes that a
toxic dictionary saves, counted per document at each threshold, are calibrated
by a logistic regression on training rows, which so weighs each tier by itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import checkpointed, in_tasks
from .logistic import fit_logistic

#: Bounds of the sample of labelled rows that the model is fitted on.
TRAINING_ROWS = 20_000
ORDINARY_ROWS, ORDINARY_BYTES = 2_000, 20_000
DICTIONARY_BYTES, PHRASES = 16_384, 1_000
WINDOW_WORDS, THRESHOLDS = 3, 14
#: Least z score of the phrases of each tier, and least smoothed log odds ratio of all.
TIERS, LEAST_ODDS = (4, 8, 16), 2
LEVEL = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)


def _sizes(compressor: zstandard.ZstdCompressor, data: np.ndarray, segments: np.ndarray) -> np.ndarray:
    done = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments.tobytes()), threads=1)
    return np.fromiter(map(len, done), np.int64, len(done))


def _windows(texts: pa.Array, words_each: int = WINDOW_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, (offset, length) of each window, its document). Windows don't overlap and keep a byte on both sides."""
    words = tx.split(texts, tx.BLANK_SEPARATED, lower=True)
    data = np.concatenate((np.full(1, 0x20, np.uint8), words.data))
    blank = ~tx.BLANK_SEPARATED[data]
    data[blank] = 0x20
    per_doc = -(-words.counts // words_each)
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    first = words.first[doc] + place * words_each
    last = np.minimum(first + words_each, words.first[doc + 1]) - 1
    a, b = words.starts[first], words.ends[last]
    return data, np.stack([a, b - a + 2], 1).astype(np.uint64), doc


class Model:
    def __init__(self, ordinary: bytes, toxic: list[bytes], weights: np.ndarray | None = None):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def features(self, texts: pa.Array) -> np.ndarray:
        data, segments, doc = _windows(texts)
        n = np.bincount(doc, minlength=len(texts))
        out = np.zeros((len(texts), len(TIERS) * THRESHOLDS + 1))
        if len(doc) and any(self.toxic):
            plain = _sizes(_compressor(self.ordinary), data, segments)
            for t, toxic in enumerate(self.toxic):
                if toxic:
                    saved = plain - _sizes(_compressor(toxic), data, segments)
                    for k in range(THRESHOLDS):
                        out[:, t * THRESHOLDS + k] = np.log1p(np.bincount(doc[saved > k], minlength=len(texts)))
        out[:, -1] = np.log1p(n)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        x = self.features(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _features(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            x = model.value.features(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _score(model, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            s = model.value.score(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def _phrases(rows: DataFrame) -> list[bytes]:
    """Words that mark toxic rows, by the z score of their document frequency, as one string for each tier.

    z alone would let in ordinary words of a slightly higher frequency once rows
    are many, so the odds of a toxic row must differ as well.
    """
    n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    share = toxic / n
    words = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0)))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    z = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)) + 1)
    a, b = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(a / (toxic + 1 - a)) - F.log(b / (n - toxic + 1 - b))
    found = counts.withColumn("z", z).where((F.col("z") > TIERS[0]) & (odds > LEAST_ODDS)).orderBy(F.desc("z"), "w").limit(PHRASES).collect()
    tiers = zip(TIERS, [*TIERS[1:], math.inf], strict=True)
    return [b"".join(b" " + w.encode() + b" " for w in sorted(r["w"] for r in found if low < r["z"] <= high)) for low, high in tiers]


def fit(docs: DataFrame, labels: DataFrame, training: int = TRAINING_ROWS) -> Model:
    """A model from at most `training` labelled rows, chosen by a hash of their ids; rows of docs and labels need doc_id, text and toxic (0 or 1).

    An id with labels of both kinds counts as toxic; of several texts of an id the smallest is
    taken. Ordinary rows of over ORDINARY_BYTES are no part of the ordinary dictionary.
    """
    spark = docs.sparkSession
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # training rows of 12 bytes
    rows = checkpointed(own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    count, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == count:
        prior = (toxic + 0.5) / (count + 1)
        return Model(b"", [], np.append(np.zeros(len(TIERS) * THRESHOLDS + 1), math.log(prior / (1 - prior))))
    plain = rows.where(f"toxic = 0 and octet_length(text) <= {ORDINARY_BYTES}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDINARY_ROWS).select("text").toArrow()["text"].combine_chunks()
    data, segments, _ = _windows(plain)
    windows = [data[a : a + n].tobytes() for a, n in segments.astype(np.int64).tolist()]
    phrases = _phrases(rows)
    try:
        ordinary = zstandard.train_dictionary(DICTIONARY_BYTES, windows).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        ordinary = b"".join(windows)[-DICTIONARY_BYTES:]
    room = max(map(len, phrases))
    padding = b"".join(windows[:: max(1, len(windows) * 16 // max(1, room))])[:room]
    model = Model(ordinary + padding, [ordinary + padding[: max(0, len(padding) - len(p))] + p if p else b"" for p in phrases])
    seen = rows.select("toxic", "text").mapInArrow(in_tasks(_features(spark.sparkContext.broadcast(model))), "toxic int, x array<double>").toPandas()
    model.weights = fit_logistic(np.stack(seen["x"]), seen["toxic"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, training: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text; others are ignored).

    Rows whose crc32 of the id as text leaves 1 modulo 3 are held out: their
    labels are not used. labels needs doc_id and toxic; without both classes among
    the rest every score is the share of toxic rows. Null and empty texts get the
    score of no windows; a null id is not held out.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(docs, labels.where(~held), training)
    spark = docs.sparkSession
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")).mapInArrow(
        in_tasks(_score(spark.sparkContext.broadcast(model), threshold)), "doc_id long, held_out boolean, score double, predicted int"
    )
