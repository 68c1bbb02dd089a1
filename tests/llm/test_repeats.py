"""Substring and suffix-array dedup against plain Python."""

import hashlib
from collections import defaultdict

import pytest
from oreframe.llm import substring_dedup, suffix_dedup


@pytest.mark.parametrize("window", [3, 13])
def test_substring_dedup(docs, no_docs, window):
    rows = docs.collect()
    words = {r["doc_id"]: (r["text"] or "").encode().split() for r in rows}
    least = {}
    for d in sorted(words):
        for k in range(len(words[d]) - window + 1):
            least.setdefault(tuple(words[d][k : k + window]), d)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs.unionByName(docs.where("doc_id in (0, 3, 4)")), window).collect()}
    assert len(got) == len(rows)
    removed = 0
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < d:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        removed += len(gone)
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_text"]) == (len(w), len(gone), kept.decode()), d
        assert got[d]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert sum(s["end"] - s["start"] for s in got[d]["spans"]) == len(gone)
    assert removed
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_suffix_array():
    import random

    import numpy as np

    r = random.Random(5)
    for n in [1, 2, 7, 8, 9, 50, 400, 3000]:
        for letters in [b"a", b"ab", b"abcd\x00\xff"]:
            t = bytes(r.choice(letters) for _ in range(n))
            if n == 3000:
                t = t[:500] * 6
            a = np.frombuffer(t, np.uint8)
            want = sorted(range(n), key=lambda i: t[i:])
            sa = suffix_dedup.suffix_array(a)
            assert sa.tolist() == want
            shared = [0]
            for i, j in zip(want[:-1], want[1:], strict=True):
                k = 0
                while k < 40 and i + k < n and j + k < n and t[i + k] == t[j + k]:
                    k += 1
                shared.append(k)
            assert suffix_dedup.common_prefixes(a, sa, 40, lane=16).tolist() == shared


def check_bytes(table, length):
    """Suffix dedup of table against every string of length bytes; returns the bytes removed."""
    rows = table.collect()
    shortest = length * 16 // 25
    core = shortest - length // 6 + 1
    seen = {n: defaultdict(int) for n in (length, shortest, core)}
    for r in rows:
        raw = (r["text"] or "").encode()
        for n, count in seen.items():
            for k in range(len(raw) - n + 1):
                count[raw[k : k + n]] += 1
    out = suffix_dedup.remove_repeated_bytes(table, length).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in rows)
    got = {r["doc_id"]: r for r in out}
    removed = 0
    for r in rows:
        raw, gone = (r["text"] or "").encode(), set()
        again = lambda n: [k for k in range(len(raw) - n + 1) if seen[n][raw[k : k + n]] > 1]  # noqa: B023, E731
        for k in again(length):
            gone |= set(range(k, k + length))
        kept = bytes(c for i, c in enumerate(raw) if i not in gone)
        g = got[r["doc_id"]]
        removed += len(gone)
        assert (g["n_bytes"], g["n_removed"], bytes(g["kept"]), g["n_spans"]) == (len(raw), len(gone), kept, sum(i - 1 not in gone for i in gone)), (r["doc_id"], g["n_removed"], len(gone))
        assert g["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert g["n_shared"] > 0 or not again(shortest), r["doc_id"]
        assert g["n_shared"] == 0 or again(core), r["doc_id"]
    return removed


@pytest.mark.parametrize("length", [30, 60])
def test_suffix_dedup(docs, no_docs, length):
    assert check_bytes(docs.unionByName(docs.where("doc_id in (0, 3, 4)")), length)
    assert suffix_dedup.remove_repeated_bytes(no_docs).count() == 0


def test_suffix_dedup_default_length(spark):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n)[:size] for n, size in ((300, 300), (300, 399), (300, 400), (300, 401), (900, 2000))]
    texts = [prose(r.randint(0, 200)) + r.choice(passages) + prose(r.randint(0, 200)) + r.choice(passages) for _ in range(60)]
    texts += [prose(300), passages[2], passages[4] * 3, texts[0], None, "", "x" * 1500]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert check_bytes(table, 400)


def test_very_long_texts(spark):
    """Texts over the sizes at which chunks, hash blocks and shards are cut, and words longer than a hash block."""
    import random

    r = random.Random(8)
    words = [f"w{r.randrange(10**9)}" for _ in range(3000)]
    filler = lambda k: " ".join(f"{r.randrange(10**12):x}" for _ in range(k))
    passage = " ".join(words[:200])
    texts = [filler(420_000) + " " + passage + " " + filler(1000), passage + " z" * 5, "y" * (5 << 20) + " " + passage, filler(500), None]
    assert len(texts[0]) > 4 << 20
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in substring_dedup.remove_repeats(table, with_text=False).collect()}
    assert [got[i]["n_removed"] for i in range(5)] == [0, 200, 200, 0, 0]
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeated_bytes(table, with_text=False).collect()}
    # the first two share the passage with a blank on one side or both; the long word's own strings repeat within it
    assert [got[i]["n_removed"] for i in range(5)] == [len(passage) + 2, len(passage) + 1, got[2]["n_bytes"], 0, 0]
