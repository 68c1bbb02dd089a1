"""Refresh by moved quotes, scans in blocks, facets under a filter, and counts taken while writing."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oreframe.operators import company, refresh, repairs, revaluation, screen
from oreframe.operators.common import highest_before
from oreframe.plans import reval
from oreframe.sources import stores

DATA = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(map(str, df.select(*(columns or sorted(df.columns))).collect()))


def test_refresh_reads_only_what_moved(spark):
    new = reval._latest(spark, DATA)
    late = F.when(F.col("commodity") == "Cu", F.col("price_usd") * 2).otherwise(F.col("price_usd"))
    old = new.withColumn("price_usd", late)
    assert refresh.moved_quotes(old, new) == ["Cu"] and refresh.moved_quotes(new, new) == []
    assert refresh.moved_quotes(new.where("commodity <> 'Pt'"), new) == ["Pt"]
    again, concerned = reval.recomputed(spark, DATA, ["Cu"], new)
    copper = {r.study_id for r in reval._legs(spark, DATA).where("commodity = 'Cu'").collect()} & {r.study_id for r in reval._studies(spark, DATA).collect()}
    assert {r.study_id for r in concerned.collect()} == copper and concerned.count() == len(copper)
    plan = again._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "Scan parquet" in x and "_by_mover" not in x and "mover" in x]
    assert scans and all("mover" in x.split("PartitionFilters")[1].split("]")[0] for x in scans)
    everything = revaluation.revaluation_rows(reval._basket(spark, DATA))
    stored = revaluation.revaluation_rows(reval._basket(spark, DATA, revaluation.priced_studies(reval._studies(spark, DATA), reval._legs(spark, DATA), old)))
    columns = ["study_id", "price_spot_id", "commodity", F.round("npv_spot", 4), F.array_join("warnings", ";")]
    assert rows_of(stored, *columns) != rows_of(everything, *columns)
    assert rows_of(refresh.refreshed(stored, again, concerned), *columns) == rows_of(everything, *columns)
    none, nobody = reval.recomputed(spark, DATA, [], new)
    assert nobody.count() == 0 and none.count() == 0
    # several quotes that moved don't compute a study twice
    _, both = reval.recomputed(spark, DATA, ["Ag", "AUDUSD", "Cu"], new)
    assert both.count() == both.select("study_id").distinct().count() > len(copper)


def test_scans_in_blocks(spark):
    """A company with most snapshots, repeated dates and nulls: as plain windows give it."""
    r = random.Random(4)
    days = [None, *(f"20{y:02d}-{m:02d}-{d:02d}" for y in (10, 11) for m in (1, 2, 12) for d in (1, 2, 28))]
    rows = [(i, r.choice([1, 1, 1, 1, 2, 3, None]), r.choice(days), r.choice([None, 0.0, 10.0, -4.0, 7.0]), r.choice([None, 5.0, -2.0, 0.0, 9.0]), r.choice([None, 100.0, 300.0]), r.choice(["appendix_5b", "presentation", "issue_of_securities"])) for i in range(400)]
    f = spark.createDataFrame(rows, "financial_id long, company_id int, day string, cash double, burn double, shares_fd double, doc_type string").withColumn("effective_date", F.col("day").cast("date"))
    plain = f.withColumn("q", F.lag("financial_id").over(W.partitionBy("company_id").orderBy("effective_date", "financial_id")))
    got = highest_before(f, ["company_id"], ["effective_date", "financial_id"], F.date_trunc("month", "effective_date"), F.struct("effective_date", "financial_id"), "p").withColumn("q", F.col("p.financial_id")).drop("p")
    assert rows_of(got) == rows_of(plain.select(got.columns))
    one_block, blocks = repairs.review_flags(f, block=1_000), repairs.review_flags(f, block=7)
    earlier = W.partitionBy("company_id").orderBy("financial_id").rowsBetween(W.unboundedPreceding, -1)
    known = f.withColumn("p", F.max_by(F.struct("cash"), F.struct("effective_date", "financial_id")).over(earlier)).where("doc_type <> 'issue_of_securities' and p.cash <> 0 and abs(cash - p.cash) / abs(p.cash) > 0.5")
    assert rows_of(one_block) == rows_of(blocks)
    assert rows_of(blocks.where("reason like '%cash_50pct%'"), "financial_id") == rows_of(known, "financial_id")
    used = f.where("burn is not null and burn <> 0").withColumn("prior", F.lag("burn").over(W.partitionBy("company_id").orderBy("effective_date", "financial_id")))
    assert rows_of(company.burn_trend(f), "financial_id", "prior") == rows_of(used, "financial_id", "prior")
    assert repairs.review_flags(f.limit(0)).count() == 0


def test_facets_under_filter(spark):
    rows = [("a", ["AU"], ["Au"], "production"), ("b", ["AU", "CA"], ["Au", "Cu"], "exploration"), ("c", ["CA"], [], "production"), ("d", None, ["Cu"], None), ("e", ["AU"], ["Cu"], "production")]
    s = spark.createDataFrame(rows, "ticker string, countries array<string>, commodities array<string>, most_advanced string").withColumns({"states": F.array().cast("array<string>"), "regions": F.lit(None).cast("array<string>")})
    got = lambda **chosen: {(r.facet, r.value): r.n for r in screen.facets_under_filter(s, chosen).collect()}
    assert got() == {("country", "AU"): 3, ("country", "CA"): 2, ("commodity", "Au"): 2, ("commodity", "Cu"): 3, ("stage", "production"): 3, ("stage", "exploration"): 1}
    assert got(country="AU") == {("country", "AU"): 3, ("country", "CA"): 2, ("commodity", "Au"): 2, ("commodity", "Cu"): 2, ("stage", "production"): 2, ("stage", "exploration"): 1}
    assert got(country="CA", stage="production") == {("country", "AU"): 2, ("country", "CA"): 1, ("stage", "production"): 1, ("stage", "exploration"): 1}
    assert got(commodity="Zn", country="XX") == {}


def test_counts_while_writing(spark, tmp_path):
    gated = spark.range(1000).select(F.col("id").alias("study_id"), F.when(F.col("id") % 3 == 0, "missing").alias("reason")).repartition(7)
    counts = stores.write_sweep(gated, str(tmp_path / "sweep"))
    want = revaluation.sweep_stats(gated).first().asDict()
    assert counts == {k: want[k] for k in counts} == {"total": 1000, "refreshed": 666, "errors": 334}
    assert spark.read.parquet(str(tmp_path / "sweep")).count() == 1000
    assert stores.write_sweep(gated.limit(0), str(tmp_path / "none")) == {"total": 0, "refreshed": 0, "errors": 0}
    new = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01"), (3, "2023-02-01")], "document_id long, effective_date string")
    assert stores.append_snapshots(new, new.where("document_id = 2"), str(tmp_path / "s")) == 2
    assert stores.append_snapshots(new, new, str(tmp_path / "s")) == 0
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
