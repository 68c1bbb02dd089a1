"""Infilling, ranked search and HyperMinHash against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oreframe.llm import hyperminhash, infilling, ranked_search

from pyspark.sql import functions as F


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_units():
    r = random.Random(3)
    for n in [*range(40), 300]:
        text = "".join(r.choice("a é€😀́") for _ in range(n))
        data = np.frombuffer(text.encode(), np.uint8)
        units = infilling.Units(data)
        ends = np.cumsum([0] + [len(c.encode()) for c in text])
        assert units.select(np.arange(n + 1)).tolist() == ends.tolist()
        assert units.rank(ends).tolist() == list(range(n + 1))


def test_infilling(spark, docs):
    odd = [(2000 + i, t) for i, t in enumerate(["<P>", "a<S>b", "x<M", "<", "P>", "<S", "é" * 5000 + "😀" * 3000, "́a", "a\x00b", "😀"] * 4)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + odd + [(None, "nameless text"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(3)
    got = infilling.fill_in_middle(df)
    got = got.withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    want = []
    for i, t in rows:
        t = t or ""
        h = [int(sha(f"1:{'null' if i is None else i}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((i, len(t), "plain", None, None, t, t))
        elif h[3] % 100 < 20:
            want.append((i, len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", t))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    some = infilling.fill_in_middle(df, seed=2, plain_percent=0, spm_percent=100).collect()
    assert {r.form for r in some} == {"plain", "spm"}


def ranked(docs, items, k):
    terms = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    tf = [(d, Counter(terms(t))) for d, t in docs]
    tf = [(d, c, c.total()) for d, c in tf if c]
    n_docs, n_words = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in tf:
            m = 75 + 25 * n * n_docs // n_words
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, x in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        out += [(item, rank + 1, None if d == math.inf else d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("k,block_bytes", [(20, 8 << 20), (3, 500), (1, 1)])
def test_ranked_search(spark, docs, k, block_bytes):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(None, rows[4][1]), rows[4], rows[4], (999, "Wort WORT wort"), (998, "wort Wort WORT"), (997, "É é")]
    items = [(i, rows[i * 3][1]) for i in range(12)] + [(50, "wort wort"), (50, "zebra"), (51, None), (52, " .,- "), (None, "WORT é"), (53, "ab"), (54, "É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")).repartition(2)
    got = ranked_search.rank_documents(df, bench, k, block_bytes)
    assert sorted(str(tuple(r)) for r in got.collect()) == ranked(rows, items, k)


def test_ranked_search_of_nothing(spark, no_docs, docs):
    items = spark.createDataFrame([(1, "ab cd"), (2, None)], "item_id long, text string")
    assert ranked_search.rank_documents(no_docs, items).count() == 0
    assert ranked_search.rank_documents(docs, items.where("item_id > 1")).count() == 0
    assert infilling.fill_in_middle(no_docs).count() == 0
    assert hyperminhash.near_duplicates(no_docs).count() == 0
    assert hyperminhash.near_duplicates(docs.where("text = ''")).select("n_shingles", "kept").distinct().collect() == [(0, True)]


def components(rows, size, num, den):
    sets = []
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append((math.inf if d is None else d, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and label[i] != label[j] and den * len(a & b) >= num * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (d, _) in zip(label, sets, strict=True):
        least[x] = min(d, least.get(x, d))
    null = lambda d: None if d == math.inf else d
    return sorted(str((null(d), len(s), null(least[x]), d == least[x])) for x, (d, s) in zip(label, sets, strict=True))


def near_copies(seed):
    """Chains and stars of near copies around the threshold, short texts, and texts that share long passages without being copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    out, passage = [], [word() for _ in range(60)]
    for _ in range(8):
        words = [word() for _ in range(r.choice([2, 6, 20, 60, 200]))]
        for _ in range(r.choice([2, 5, 25])):
            w = list(words if r.random() < 0.5 or not out else out[-1].split())
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [word()], [w[k], word()]])
            out.append(" ".join(w) or "x")
    return out + [" ".join(passage[: r.randint(40, 60)] + [word() for _ in range(r.randint(2, 25))]) for _ in range(60)]


@pytest.mark.parametrize("seed,part_size,part_shingles", [(1, 512, 1 << 21), (2, 3, 1 << 21), (3, 1, 400)])
def test_hyperminhash(spark, docs, seed, part_size, part_shingles):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 - i, t) for i, t in enumerate(near_copies(seed))]
    rows += [rows[3], rows[70], (None, rows[71][1]), (None, "alone without a name"), (None, rows[72][1] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "row": F.lit("clash")}).repartition(3)
    got = sorted(str(tuple(r)) for r in hyperminhash.near_duplicates(df, part_size=part_size, part_shingles=part_shingles).collect())
    want = components(rows, 2, 4, 5)
    assert got == want
    assert sum("True)" in w for w in want) < len(want) - 20


def test_estimates():
    """Registers of unrelated sets agree as often as reckoned, and estimates are near the true similarity."""
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for n, m in ((100_000, 100_000), (300_000, 3_000)):
        a, b = hyperminhash.registers([fresh(n), fresh(m)])
        p = float(hyperminhash.accidental(np.array([n]), m)[0])
        assert abs(float((a == b).mean()) - p) < 5 * math.sqrt(p / hyperminhash.BUCKETS) + 1e-9 and 0 < p < 2e-3
    for n in (5, 40, 300, 5000):
        common = fresh(8 * n)
        x, y = np.concatenate((common, fresh(n))), np.concatenate((common, fresh(n)))
        r = hyperminhash.registers([x, y])
        estimate, maybe = hyperminhash.near(r[0], len(x), r[1:], np.array([len(y)]), 0.8)
        assert abs(estimate[0] - 0.8) < 0.2 and maybe[0]
        r = hyperminhash.registers([x, fresh(9 * n)])
        assert n == 5 or not hyperminhash.near(r[0], len(x), r[1:], np.array([9 * n]), 0.8)[1][0]
