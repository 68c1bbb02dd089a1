"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from oreframe.plans.bind import TABLES
from oreframe.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def norm(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)):
        return "nan" if math.isnan(x) else f"{x:.6g}" if isinstance(x, float) and x != int(x) else str(int(x))
    return str(x)[:10] if hasattr(x, "year") else str(x)


@pytest.mark.parametrize("name", ("revaluations", "reval_warnings", "reval_gate", "screen_rank", "cashflow_items", "resource_rows", "merge_forks", "stage_evidence", "feed_quarantine", "asof_align"))
def test_query_with_generated_code(spark, duck, name):
    """A part of the queries as users run them; the rest of the suite goes without code generation."""
    off = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    try:
        spark.conf.set("spark.sql.codegen.wholeStage", "true")
        spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
        test_query(spark, duck, name)
    finally:
        for k, v in off.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    cur = duck.execute(ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(norm(r[cols.index(c)]) for c in names) for r in cur.fetchall())
    assert sorted(cols) == names
    assert len(got) == len(want)
    odd = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not odd, odd[:3]
    assert got
