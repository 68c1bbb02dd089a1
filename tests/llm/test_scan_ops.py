"""License scans, decontamination, mixing and sharding against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from oreframe.llm import decontamination, licenses, mixing, sharding

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def low_words(t):
    return ALNUM.findall((t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def blank_words(t):
    return BLANK.findall((t or "").encode())


def test_licenses(docs, no_docs):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    for r in docs.collect():
        w, g = low_words(r["text"]), got[r["doc_id"]]
        places, labels, best = [], set(), 0.0
        for phrase, label in licenses.PHRASES.items():
            p = phrase.encode().split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        own = set()
        for line in (r["text"] or "").split("\n"):
            for label, t in licenses.TEMPLATES:
                t = set(low_words(t))
                share = len(t & set(low_words(line))) / len(t)
                if share >= 0.9 - 1e-9:
                    own.add(label)
                    best = max(best, share)
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (g["base_labels"], g["labels"]) == (",".join(sorted(labels)), ",".join(sorted(labels | own)))
        assert g["score"] == pytest.approx(1.0 if places else best)
    assert {"cc-by", "gpl", "reserved", "cc-by-nc"} == set(got[max(got)]["labels"].split(","))
    assert licenses.scan_licenses(no_docs).count() == 0


def test_wrapped_licenses(spark):
    """Every template wrapped behind comment marks, against all windows in plain Python; scattered or divided tokens match nothing."""
    import math
    import random
    import textwrap

    r = random.Random(5)
    noise = lambda k: " ".join(r.choice(["the", "of", "license", "under", "this", "is", "zeta", "eta", "work", "and"]) for _ in range(k))
    texts = []
    for _, t in licenses.TEMPLATES:
        for width in (12, 30, 75):
            texts.append(noise(40) + "\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, width, break_long_words=False)) + "\n" + noise(40))
        w = t.split()
        texts += [" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :]), "\nzeta eta iota theta\n".join(w), "\n".join([*w[:3], "zeta", *w[3:]])]
    got = [r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), phrases={}).collect()]
    for g in got:
        text, labels, best = texts[g["doc_id"]], set(), 0.0
        w = low_words(text)
        for label, t in licenses.TEMPLATES:
            t, tokens = low_words(t), set(low_words(t))
            width = math.ceil(len(t) / 0.9 - 1e-9)
            for block in [low_words(x) for x in text.split("\n")] + [w[k : k + width] for k in range(len(w))]:
                share = len(tokens & set(block)) / len(tokens)
                if share >= 0.9 - 1e-9:
                    labels.add(label)
                    best = max(best, share)
        assert g["labels"] == ",".join(sorted(labels)) and g["score"] == pytest.approx(best)
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert all(label in got[7 * i + k]["labels"].split(",") and got[7 * i + k]["score"] == 1 for k in range(3))
        assert not any(label in got[7 * i + k]["labels"].split(",") for k in (3, 5))


@pytest.mark.parametrize("block_bytes", [1 << 25, 700])
def test_decontamination(spark, docs, no_docs, block_bytes):
    rows = docs.collect()
    cut = [" ".join((r["text"] or "").split(" ")[a : a + n]) for r, a, n in zip(rows, [0, 3, 9, 20, 1, 0, 30, 2] * 3, [40, 13, 14, 25, 5, 2, 60, 12] * 3, strict=False)]
    items = [*enumerate(cut), (900, None), (901, ""), (902, "ab"), (None, "cd cd"), (903, "zzz never there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert len(got) == len(rows)
    seen = 0
    for r in rows:
        w, hit, found = low_words(r["text"]), set(), set()
        for i, t in items:
            t = low_words(t)
            n = min(13, len(t))
            if i is None or not n:
                continue
            own = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in own:
                    hit |= set(range(k, k + n))
                    found.add(str(i))
        g = got[r["doc_id"]]
        seen += len(hit)
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
        assert g["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert seen
    assert decontamination.find_contamination(no_docs, bench).count() == 0
    assert not decontamination.find_contamination(docs, bench.limit(0)).where("contaminated or n_hit > 0").count()


def test_decontamination_by_row(spark):
    """With several blocks, rows without an id and rows that repeat one have results of their own."""
    texts = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(30)]
    bench = spark.createDataFrame(list(enumerate(texts[:12])), "item_id long, text string")
    ids = [None, None, None, 7, 7, 7, 8, None]
    rows = list(zip(ids, [texts[0], texts[1], texts[20], texts[2], texts[3] + " tail" * 500, texts[21], texts[4], None], strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, several = ([tuple(r) for r in decontamination.find_contamination(docs, bench, block_bytes=b).collect()] for b in (1 << 25, 300))
    key = lambda r: tuple(map(str, r))
    assert sorted(several, key=key) == sorted(one, key=key)
    assert sorted((str(r[0]), r[1], r[2], r[3], r[5]) for r in several) == sorted(
        (str(i), n, hit, int(hit > 0), bad) for i, n, hit, bad in zip(ids, [20, 20, 20, 20, 520, 20, 20, 0], [20, 20, 0, 20, 20, 0, 20, 0], [True, True, False, True, False, False, True, False], strict=True)
    )


def level_fill(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("fanout", [4, 64])
def test_mixing(docs, no_docs, fanout):
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs, fanout=fanout).collect()}
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(blank_words(r["text"]))
    want = level_fill(sizes, (5, 2, 1), 1.5, 2.0)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        g, n = got[r["doc_id"]], len(blank_words(r["text"]))
        assert g["size"] == n and g["source_size"] == sizes[r["source"]] and g["target"] == pytest.approx(want[r["source"]])
        assert 0 <= g["taken"] <= 2 * n and (not n or g["taken"] % n == 0)
        taken[r["source"]] += g["taken"]
        largest[r["source"]] = max(largest[r["source"]], n)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(5), fanout=fanout).collect()}
    assert again == {k: r["taken"] for k, r in got.items()}
    assert mixing.mix_sources(no_docs).count() == 0


def test_mixing_repeated_rows(docs):
    twice = docs.unionByName(docs)
    assert mixing.mix_sources(twice, fanout=4).count() == twice.count()


def test_mixing_stage_without_ids(spark):
    """Rows without an id share in the rounding and reach the mix: each source meets its target to within a document."""
    import corpus_pipeline

    rows = [(i if i % 3 else None, " ".join(f"t{i}" for _ in range(3 + i % 9)), "xyz"[i % 7 % 3]) for i in range(150)] + [(None, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(blank_words(t))
        largest[s] = max(largest[s], len(blank_words(t)))
    want = level_fill(sizes, (5, 2, 1), 1.5, 2.0)
    mixed = [tuple(r) for r in corpus_pipeline.mixing_stage(spark, docs, "").collect()]
    for _, t, s in mixed:
        taken[s] += len(blank_words(t))
    assert all(abs(taken[s] - want[s]) <= largest[s] + 1e-6 for s in sizes)
    assert set(mixed) <= set(rows) and any(i is None for i, *_ in mixed)
    assert all(mixed.count(r) <= 2 for r in mixed)
    direct = mixing.mix_sources(docs, fanout=4).collect()
    assert len(direct) == len(rows)
    for target in {r["target"] for r in direct}:
        assert abs(sum(r["taken"] for r in direct if r["target"] == target) - target) <= 11


@pytest.mark.parametrize("shards", [1, 3, 7, 40])
def test_sharding(docs, no_docs, shards, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    rows = docs.collect()
    out = sharding.assign_shards(docs, shards, rows_per_part=3).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    by_text, slots, filled = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in rows:
        g, raw = got[r["doc_id"]], (r["text"] or "").encode()
        assert (g["size"], g["text_crc32"], g["law"]) == (len(raw) + 16, zlib.crc32(raw), "bytes")
        by_text[raw].add(g["shard"])
        slots[g["shard"]].append(g["slot"])
        filled[g["shard"]] += g["size"]
    assert all(len(x) == 1 for x in by_text.values()) and all(0 <= s < shards for s in slots)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    from pyspark.sql import functions as F
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("b")).groupBy("k").sum("b").orderBy("k").collect()
    sums = [r[1] for r in keyed]

    def fits(c):
        n, at = 1, 0
        for s in sums:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    assert max(filled.values()) == next(c for c in range(max(sums), sum(sums) + 1) if fits(c))
    assert sharding.assign_shards(no_docs, shards).count() == 0
