import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("size", T.LongType()), T.StructField("key", T.StringType()), T.StructField("p", T.StringType()),
])


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    """Random texts with shared passages, near copies, copies, nulls, repeats and odd bytes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    prose = lambda k: " ".join(word() + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(k))
    passages = [prose(r.choice([12, 13, 14, 30, 80])) for _ in range(6)]
    out: list[str | None] = []
    for i in range(n):
        kind = r.random()
        if kind < 0.15 and i:
            base = out[r.randrange(len(out))] or ""
            words = base.split(" ")
            for _ in range(r.randint(0, 3)):
                if words:
                    words[r.randrange(len(words))] = word()
            out.append(" ".join(words))
        elif kind < 0.6:
            out.append(prose(r.randint(0, 60)) + " " + r.choice(passages) + r.choice([" ", "\n"]) + prose(r.randint(0, 60)))
        elif kind < 0.7:
            out.append("ab " * r.randint(1, 300))
        else:
            out.append(prose(r.randint(1, 150)))
    return [*out, None, "", " \n ", "ÀB Cd\tcd", out[3], out[3], None, "All rights reserved. CC\nBY the GNU general public license, version 3.\nLicensed under CC BY-NC 4.0."]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "b", "b", "é"][i % 6], len(t or ""), 5, "k", "p") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
