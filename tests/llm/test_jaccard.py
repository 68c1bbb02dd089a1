import random
import re

import pytest
from oreframe.llm import jaccard

from pyspark.sql import functions as F


def want(rows, size):
    sets = []
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append((d, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


def near_copies(seed):
    """Chains and stars of near copies around the threshold, and texts made of common passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    out, pool = [], [[word() for _ in range(25)] for _ in range(4)]
    for _ in range(6):
        words = [word() for _ in range(r.choice([6, 20, 60, 120]))]
        for _ in range(r.choice([2, 5, 30])):
            base = words if r.random() < 0.5 else out[-1].split() if out else words
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [word()], [w[k], word()]])
            out.append(" ".join(w) or "x")
    for _ in range(20):
        out.append(" ".join(sum(r.sample(pool, r.randint(1, 3)), [])) + " " + word())
    return out


@pytest.mark.parametrize("seed,part_size,size", [(1, 512, 5), (2, 3, 5), (3, 1, 3)])
def test_components(spark, docs, seed, part_size, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(1000 - i, t) for i, t in enumerate(near_copies(seed))]
    df = spark.createDataFrame([*rows, rows[3], rows[70]], "doc_id long, text string").withColumn("n", F.lit("x")).repartition(3)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, size, part_size=part_size).collect())
    assert got == want([*rows, rows[3], rows[70]], size)
    assert len({c for _, _, c in got}) < len(got) - 20


def test_empty(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0
