"""What the review of round 3 found."""

import duckdb
from pyspark.sql import functions as F

from oreframe.operators import revaluation
from oreframe.plans import base, reval


def test_places_as_sql_rounds_them(spark):
    """Values of the screener (an order's price over 9000, less 10), of which some end in a 5 by their digits only."""
    spark.range(1, 400_000, 7).select((F.col("id") / 100.0).alias("p")).createOrReplaceTempView("p")
    got = spark.table("p").select("p", base.rounded(F.col("p") / 9000.0 - 10, 4).alias("r"), F.round(F.col("p") / 9000.0 - 10, 4).alias("digits")).collect()
    c = duckdb.connect()
    want = dict(c.execute("select i / 100.0::double, round(i / 100.0::double / 9000.0 - 10, 4) from range(1, 400000, 7) r(i)").fetchall())
    assert {r.p: r.r for r in got} == want
    assert any(want[r.p] != r.digits for r in got)
    odd = spark.createDataFrame([(None,), (float("inf"),), (-0.5,), (2.5,)], "x double").select(base.rounded("x", 0).alias("r")).collect()
    assert [r.r for r in odd] == [None, float("inf"), -1.0, 3.0]


def test_revaluations_shuffle_no_studies(spark):
    """Once written, studies with their legs are joined with nothing by project: before, every study went by project_id with all its legs."""
    d = "/root/testdata/sf0.001"
    for out in (reval.revaluations(spark, d), reval.reval_warnings(spark, d), reval.resolve_legs(spark, d)):
        assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString().replace("Exchange hashpartitioning(commodity", "")


def test_sweep_tells_errors_by_kind(spark):
    """Before, refusals for what a study is or lacks weren't told from numbers and quotes that fail."""
    reasons = [None, None, "not_revaluable_tier:conceptual", "missing_fields:mine_life_years", "reporting_currency_not_supported:CAD", "no_study_commodities", "not_revaluable_no_supported_commodity",
               "study_not_found", "fx_missing:AUDUSD", "spot_missing:Au", "discount_rate_not_positive"]
    gated = spark.createDataFrame([(r,) for r in reasons], "reason string")
    assert revaluation.sweep_stats(gated, kinds=True).first().asDict() == {"total": 11, "refreshed": 2, "skipped": 0, "errors": 9, "unfit": 5, "failed": 4}
    assert revaluation.sweep_stats(gated.limit(0), kinds=True).first().asDict() == {"total": 0, "refreshed": 0, "skipped": 0, "errors": 0, "unfit": 0, "failed": 0}
    assert revaluation.sweep_stats(gated).columns == ["total", "refreshed", "skipped", "errors"]
    d = "/root/testdata/sf0.001"
    told = [r.reason for r in reval.reval_gate(spark, d).collect()]
    unfit = sum(r is not None and r.startswith(("not_revaluable", "missing_fields", "reporting_currency", "no_study")) for r in told)
    failed = sum(r is not None for r in told) - unfit
    assert unfit and failed
    assert reval.sweep_stats(spark, d).first().asDict() == {"total": len(told), "refreshed": told.count(None), "skipped": 0, "errors": unfit + failed, "unfit": unfit, "failed": failed}
