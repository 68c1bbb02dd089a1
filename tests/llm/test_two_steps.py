"""Exchanges whose entries travel in two steps: the same results, and a cost for an entry that doesn't grow with the number of parts."""

import numpy as np
import pyarrow as pa
import pytest
from oreframe.llm import _exchange as ex
from oreframe.llm import jaccard, substring_dedup, suffix_dedup


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("run, tasks", [
    (lambda d: substring_dedup.remove_repeats(d, 5), 2), (lambda d: suffix_dedup.remove_repeated_bytes(d, 60), 100), (lambda d: jaccard.jaccard_components(d), 100),
])
def test_same_results(docs, monkeypatch, run, tasks):
    monkeypatch.setattr(ex, "parts_of", lambda d: ex.Parts(3))
    few = rows_of(run(docs))
    two_steps = ex.Parts(23, one_step=4)
    assert two_steps.width == 4 and ex.Parts(4, one_step=4).width == 1
    monkeypatch.setattr(ex, "parts_of", lambda d: two_steps)
    monkeypatch.setattr(ex, "MAX_TASKS", tasks)
    assert rows_of(run(docs)) == few


def entries(seed, n, docs):
    r = np.random.default_rng(seed)
    doc = np.sort(r.integers(0, docs, n)).astype(np.int64)
    start = np.searchsorted(doc, doc)
    return doc, (np.arange(n) - start) * 7, r.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64)


def cost(parts, docs, chunks=12, n=120_000):
    """(bytes an entry in the first step, in the last, all entries as they arrive)."""
    first, second, out = 0, 0, []
    groups: dict[int, list] = {}
    for seed in range(chunks):
        doc, place, h = entries(seed, n, docs)
        for m in ex.pack(parts, ex.ENTRIES, ex.hash_part(h, parts), doc, place, [h]):
            first += len(m[2])
            groups.setdefault(m[0] // parts.width, []).append(m)
    for messages in groups.values():
        for part, kind, body in ex.read(ex.merge(1 << 20)(ex.record_batches(iter(messages), 50_000))):
            second += len(body)
            assert kind == ex.ENTRIES
            doc, place, h = ex.unpack([body])
            assert (ex.hash_part(h, parts) == part).all()
            out.append(np.stack([doc, place, h.view(np.int64)]))
    got = np.concatenate(out, axis=1)
    return first / (chunks * n), second / (chunks * n), got[:, np.lexsort(got)]


def test_cost_of_an_entry():
    """What remains is that entries of one document in one message share its id and length (12 bytes), which long documents do in few parts only."""
    for docs, most in ((100_000, 1.5), (8_000, 1.7), (400, 2.2)):
        few, many = cost(ex.Parts(10), docs), cost(ex.Parts(10_000), docs)
        assert (few[2] == many[2]).all()
        assert many[0] < most * few[0] and many[1] < most * few[0]
        one_step = cost(ex.Parts(10_000, one_step=1 << 30), docs)
        assert one_step[0] > 1.4 * max(many[:2])


def test_other_messages_pass():
    batches = ex.record_batches(iter([ex.message(3, ex.TEXT, b"x"), *ex.pack(ex.Parts(9, 4), ex.PLACES, np.array([4, 5], np.int32), np.array([1, 1]), np.array([0, 9]))]))
    got = list(ex.read(ex.merge()(batches)))
    assert sorted((p, k) for p, k, _ in got) == [(3, ex.TEXT), (4, ex.PLACES), (5, ex.PLACES)]
    assert list(ex.merge()(iter([]))) == [] and list(ex.merge()(iter([pa.record_batch([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["part", "kind", "body"])]))) == []
