"""Vectorised word splitting and hashing for Arrow batches, used inside tasks.

Everything works on one chunk of texts at a time: the texts are joined with a
blank between documents, so that words and windows never cross a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Bytes of text hashed at once.
HASH_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 61, 1 << 62, dtype=np.uint64)) | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WINDOW_CODE = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}

#: `[^\x20\x09-\x0D]+`
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, of text with A-Z in lower case
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, HASH_BYTES + (1 << 16))
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > 4 * HASH_BYTES:  # one giant word: not kept
            return out
        _POWERS[base] = have = out
    return have


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], in order of start; equal bytes have equal hashes. Worked out for HASH_BYTES of data at a time, to bound memory."""
    out = np.empty(len(starts), np.uint64)
    cut = np.concatenate(([0], np.searchsorted(starts, np.arange(HASH_BYTES, len(data), HASH_BYTES)), [len(starts)]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if a < b:
            low, high = int(starts[a]), int(ends[a:b].max())
            s, e = starts[a:b] - low, ends[a:b] - low
            prefix = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE_CODE[data[low:high]] * _powers(_BASE, high - low)[: high - low], out=prefix[1:])
            out[a:b] = mix((prefix[e] - prefix[s]) * _powers(_BASE_INV, high - low + 1)[s] + (e - s).astype(np.uint64))
    return out


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _WINDOW_CODE[0]
    for k in range(1, width):
        out += h[k : n + k] * _WINDOW_CODE[k]
    return mix(out)


def order(h: np.ndarray) -> np.ndarray:
    """Indices that sort h, equal values by index; packs the index into the low bits, as sorting values is much faster than sorting indices."""
    bits = np.uint64(max(1, int(len(h) - 1).bit_length()))
    mask = np.uint64((1 << int(bits)) - 1)
    key = np.sort((h & ~mask) | np.arange(len(h), dtype=np.uint64))
    at = (key & mask).astype(np.int64)
    s = h[at]
    return at if len(s) < 2 or bool((s[1:] >= s[:-1]).all()) else np.argsort(h, kind="stable")


def _sliding(h: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


#: Values of which minima are sought at once: few enough for the processor's cache.
MINIMA_BLOCK = 1 << 15


def minima(h: np.ndarray, w: int) -> np.ndarray:
    """Places of h that hold the minimum of some window of w values; ties keep every place. All places if there are fewer than w."""
    if len(h) < w:
        return np.arange(len(h))
    pad = np.zeros(w - 1, np.uint64)
    step, out = max(MINIMA_BLOCK, 4 * w), []
    for a in range(0, len(h), step):
        low = max(0, a - w + 1)
        own = h[low : a + step + w - 1]  # every window that holds one of the step places
        held = _sliding(np.concatenate((pad, _sliding(own, w, np.minimum), pad)), w, np.maximum) == own
        out.append(np.flatnonzero(held[a - low : a - low + step]) + a)
    return np.concatenate(out)


def groups(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each group of equal neighbours, group number of each element)."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.empty(len(sorted_values), bool)
    new[0] = True
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return np.flatnonzero(new), np.cumsum(new) - 1


@dataclass
class Words:
    """The words of a chunk. Word i is data[starts[i]:ends[i]]; document d has words first[d]:first[d + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def inside(self, width: int) -> np.ndarray:
        """Of each start of a window of width words: whether the window lies in one document."""
        n = max(0, len(self.starts) - width + 1)
        ok = np.ones(n, bool)
        for e in self.first[1:-1]:
            ok[max(0, e - width + 1) : e] = False
        return ok


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, each followed by a blank, and where each text starts (one more: the end). Null counts as empty."""
    lengths = pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    one = pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), pc.fill_null(texts.cast(pa.large_string()), ""))
    data = pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_buffer() if len(texts) else pa.py_buffer(b"")
    return np.append(np.frombuffer(data, np.uint8), np.uint8(0x20)) if len(texts) else np.empty(0, np.uint8), starts


def split(texts: pa.Array, word_bytes: np.ndarray, lower: bool = False) -> Words:
    data, text_starts = joined(texts)
    if lower:
        data = _LOWER[data]
    inside = word_bytes[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    return Words(data, starts, ends, np.searchsorted(starts, text_starts), text_starts)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of a piece have at most limit bytes (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False))
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at, done = to, int(size[to - 1])


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, neighbours put together while their texts have at most limit bytes."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()))).as_py() or 0
        if held and size + own > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.concat_batches(held)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of n places, whether one of the spans start:start + width covers them."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]
