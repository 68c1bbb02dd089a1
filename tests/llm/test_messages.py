"""Messages of repeats' exchanges: their number follows parts, not the chunks of a task or the senders of a part, and results don't depend on any of them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from oreframe.llm import _exchange as ex
from oreframe.llm import _text as tx
from oreframe.llm import substring_dedup as words
from oreframe.llm import suffix_dedup as strings

PARTS = ex.Parts(4)
#: The first step, the others, how many of them are before the one that reads texts and sends entries, and kinds that a step sends.
OPERATORS = {
    "op1": (words._probe(13, 7, PARTS), [words._match_anchors(7, PARTS), words._extend(13, 7, PARTS), words._match_windows(PARTS), words._cut(13, True)], 2),
    "op5": (strings._anchors(60, 38, PARTS), [strings._compare_anchors(PARTS), strings._shard(60, PARTS), strings._merge(PARTS), strings._cut(60, True)], 3),
}


def batches(n=80):
    """A batch for each text."""
    r = random.Random(4)
    prose = lambda k: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(k))
    passages = [prose(k) for k in (13, 20, 40, 90)]
    out = [prose(r.randint(0, 40)) + " " + r.choice(passages) + " " + prose(r.randint(0, 40)) for _ in range(n)]
    return [pa.record_batch([pa.array([i], pa.int64()), pa.array([t], pa.string())], ["doc_id", "text"]) for i, t in enumerate([*out, None, "", out[3], "ab " * 99])]


def run(operator, senders):
    """(rows, the most messages that a part or sender made in each step); senders: the batches of each task."""
    first, steps, _ = OPERATORS[operator]
    texts = [m for own in senders for m in ex.read(ex.send_texts(PARTS)(iter(own)))]
    made = [list(ex.read(first(iter(own)))) for own in senders]
    most = [max(map(len, made))]
    for f in steps:
        dealt = {p: [] for p in range(PARTS)}
        for m in [x for own in made for x in own] + (texts if f in (steps[1], steps[3]) else []):
            dealt[m[0]].append(m)
        out = [list(f(ex.record_batches(iter(own), 1_000))) for own in dealt.values()]
        if f is not steps[3]:
            made = [list(ex.read(iter(own))) for own in out]
            most.append(max(map(len, made)))
    rows = [x for own in out for b in own for x in b.to_pylist()]
    return sorted(rows, key=lambda x: x["doc_id"]), most


@pytest.mark.parametrize("operator", OPERATORS)
def test_number_of_messages(operator):
    kinds, all_batches = OPERATORS[operator][2], batches()
    rows, _ = run(operator, [[pa.concat_batches(all_batches)]])
    assert len(rows) == len(all_batches) and sum(x["n_removed"] for x in rows) > 1000
    # a chunk for each text, all of one task
    chunked, most = run(operator, [all_batches])
    assert chunked == rows
    assert most[0] <= kinds * PARTS
    # a sender for each text: places go to the part's own documents, entries to all parts
    dealt, most = run(operator, [[b] for b in all_batches])
    assert dealt == rows
    assert most[2] <= PARTS + kinds


@pytest.mark.parametrize("operator", OPERATORS)
def test_little_is_held(operator, monkeypatch):
    rows, few = run(operator, [batches()])
    monkeypatch.setattr(ex, "HELD_BYTES", 500)
    monkeypatch.setattr(ex, "SENT_BYTES", 100)
    again, many = run(operator, [batches()])
    assert again == rows and many[0] > few[0]


def test_ids_as_gaps():
    top = np.iinfo(np.int64).max
    close, far = [5, 6, 6, 9, 3, 300, -4, -4, 70_000], [top, 0, -top - 1, top, 7, 7, top - 1, top]
    for ids in (close, far, close + far, [top], [top, top - 3], [1 << 40, (1 << 40) + 1]):
        doc, n = np.repeat(np.array(ids), 2), 2 * len(ids)
        for part in (np.zeros(n, np.int32), np.arange(n, dtype=np.int32) % 3):
            made = [body for _, _, body in ex.pack(ex.Parts(3), ex.PLACES, part, doc, np.tile([1, 70_000], len(ids)), [np.arange(n)])]
            got, place, number = ex.unpack(made)
            assert got.dtype == np.int64 and sorted(zip(number.tolist(), got.tolist(), place.tolist(), strict=True)) == [(i, int(d), [1, 70_000][i % 2]) for i, d in enumerate(doc)]
    # a document of an entry each: its id costs a byte, not eight
    n = 5_000
    made = list(ex.pack(ex.Parts(1), ex.ENTRIES, np.zeros(n, np.int32), np.arange(n) * 3 + (1 << 50), np.zeros(n, np.int64), [np.zeros(n, np.uint32)]))
    assert len(made[0][2]) < 9 * n


def test_outbox():
    out, want, got = ex.Outbox(ex.Parts(3), limit=400), [], []
    r = np.random.default_rng(2)
    for i in range(40):
        n = int(r.integers(0, 9))
        place, h = np.sort(r.integers(0, 1 << 20, n)), r.integers(0, 1 << 63, n).astype(np.uint64)
        want += [(i, *x) for x in zip(place.tolist(), h.tolist(), strict=True)]
        got += out.put(ex.ENTRIES, ex.hash_part(h, 3), np.full(n, i), place, [h])
    assert got and out.size <= 400
    got += out.rest()
    assert out.size == 0 and list(out.rest()) == []
    doc, place, h = ex.unpack([body for _, _, body in got])
    assert sorted(zip(doc.tolist(), place.tolist(), h.tolist(), strict=True)) == sorted(want)


def test_minima_in_blocks(monkeypatch):
    r = np.random.default_rng(1)
    monkeypatch.setattr(tx, "MINIMA_BLOCK", 1)
    for n in (0, 1, 4, 5, 19, 20, 21, 24, 25, 300):
        for w, top in ((1, 3), (5, 3), (5, 1 << 62), (66, 9)):
            h = r.integers(0, top, n).astype(np.uint64)
            want = [i for i in range(n) if n < w or any(h[i] == h[a : a + w].min() for a in range(max(0, i - w + 1), min(i, n - w) + 1))]
            assert tx.minima(h, w).tolist() == want


def test_gathered():
    all_batches = batches(9)
    for limit in (0, 300, 1 << 20):
        got = list(tx.gathered(iter(all_batches), limit=limit))
        assert pa.concat_batches(got) == pa.concat_batches(all_batches)
        assert all(b.num_rows == 1 or len("".join(t or "" for t in b["text"].to_pylist()).encode()) <= limit for b in got)
    assert len(got) == 1 and list(tx.gathered(iter([]))) == []
