"""Fill-in-the-middle transformation of texts, cut at code points.

The texts of a chunk stand in one byte array that is viewed as 64-bit words. In
each word the bytes that end a code point (the next byte continues none) are marked
with a few arithmetic steps for all eight bytes together. Marks are counted by word;
the end of a text's k-th code point is then found by a binary search over the running
counts and, inside the word, by comparing all eight running counts of its bytes at once.

No shuffle: each document is transformed where it is read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._spark import in_tasks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)


class Units:
    """Where code points end in UTF-8 bytes that begin at the start of one. Blanks fill the last word."""

    def __init__(self, data: np.ndarray):
        words = np.concatenate((data, np.full(8 - len(data) % 8, 0x20, np.uint8))).view("<u8").astype(np.uint64, copy=False)
        first = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & _ONES  # a 1 in each byte that begins a code point
        self.ends = first >> np.uint64(8)
        self.ends[:-1] |= first[1:] << np.uint64(56)
        self.ends[-1:] |= np.uint64(1 << 56)
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before byte at."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.ends[word] & ((np.uint64(1) << (np.uint64(8) * byte)) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th code point, from 1; 0 for k = 0."""
        word = np.maximum(np.searchsorted(self.before, k, "left") - 1, 0)
        left = (k - self.before[word]).astype(np.uint64)
        running = self.ends[word] * _ONES  # each byte counts the marks up to it, 8 at most
        less = ~((running | _HIGH) - left * _ONES) & _HIGH
        return np.where(k > 0, word * 8 + np.bitwise_count(less) + 1, 0)


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id: the first of sha256 of "seed:id"."""
    out = [struct.unpack(">4I", hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).digest()[:16]) for i in ids]
    return np.array(out, np.int64).reshape(len(ids), 4)


def _transform(seed: int, plain_percent: int, spm_percent: int) -> Callable:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            texts = batch.column(1)
            data, starts = tx.joined(texts)
            units = Units(data)
            a, b = starts[:-1], starts[1:] - 1
            done = units.rank(a)
            n = units.rank(b) - done
            h = draws(batch.column(0).to_pylist(), seed)
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            marked = np.zeros(len(n), bool)
            for marker in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.fill_null(pc.match_substring(texts, marker), False).to_numpy(zero_copy_only=False)
            plain = (n == 0) | marked | (h[:, 2] % 100 >= 100 - plain_percent)
            spm = ~plain & (h[:, 3] % 100 < spm_percent)
            # a cut at 0 is the text's own start, which need not follow a code point's end
            cuts = [np.where(k > 0, units.select(done + k), a) for k in (low, high)]
            out = []
            for i, (x, y, z, e) in enumerate(zip(a.tolist(), cuts[0].tolist(), cuts[1].tolist(), b.tolist(), strict=True)):
                prefix, middle, suffix = data[x:y].tobytes(), data[y:z].tobytes(), data[z:e].tobytes()
                out.append(b"".join((prefix, middle, suffix) if plain[i] else (s, suffix, p, prefix, m, middle) if spm[i] else (p, prefix, s, suffix, m, middle)))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            yield pa.record_batch([
                batch.column(0), pa.array(n), pa.array(form, pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).cast(pa.string()),
            ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output of each row of docs (doc_id, text; others are ignored).

    form is plain (the text itself; cuts null), psm or spm, by hashes of seed and
    doc_id alone, so reruns and other file layouts agree. Texts that are empty, null or
    contain a marker stay plain. Rows that share a doc_id are cut at the same
    draws; a null doc_id draws as the word "null".
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(in_tasks(_transform(seed, plain_percent, spm_percent)), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of. Markers can't stand in its parts, nor come about where parts and markers meet."""
    head = F.substring(output, len(PREFIX) + 1, (1 << 31) - 1)  # both forms begin with a marker of the same length
    middle = F.substring_index(output, MIDDLE, -1)

    def parts(other: str) -> tuple[Column, Column]:
        return F.substring_index(head, other, 1), F.substring_index(F.substring_index(output, MIDDLE, 1), other, -1)

    (psm_prefix, psm_suffix), (spm_suffix, spm_prefix) = parts(SUFFIX), parts(PREFIX)
    return F.when(form == "psm", F.concat(psm_prefix, middle, psm_suffix)).when(form == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(output)


SQL = """
with d as (
    select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), 'null')) as x from documents
), h as (
    select *, cast('0x' || substr(x, 1, 8) as bigint) % (n + 1) as a, cast('0x' || substr(x, 9, 8) as bigint) % (n + 1) as b,
        cast('0x' || substr(x, 17, 8) as bigint) % 100 as c, cast('0x' || substr(x, 25, 8) as bigint) % 100 as e from d
), f as (
    select *, least(a, b) as low, greatest(a, b) as high,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= 90 then 'plain' when e < 20 then 'spm' else 'psm' end as form from h
), p as (
    select *, substr(t, 1, low) as pre, substr(t, low + 1, high - low) as mid, substr(t, high + 1) as suf from f
)
select doc_id, n, form, case when form <> 'plain' then low end as prefix_chars, case when form <> 'plain' then high - low end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
    sha256(t) as restored_sha256
from p
"""
