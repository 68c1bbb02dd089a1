"""Company snapshots and ingest operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, valuation
from . import revaluation
from .common import highest_before, top


def financials_latest(financials: DataFrame) -> DataFrame:
    return top(financials, ["company_id"], [F.desc("effective_date"), F.desc("financial_id")])


def financials_history(financials: DataFrame) -> DataFrame:
    return financials.orderBy("company_id", F.desc("effective_date"), F.desc("financial_id"))


QUARTERLY = ("appendix_5b", "quarterly_activity")


def cash_history(financials: DataFrame) -> DataFrame:
    """Cash rows of quarterly filings with the quarter's label and the size of the burn."""
    f = financials.where(F.col("doc_type").isin(*QUARTERLY) & F.col("cash").isNotNull())
    label = F.concat(F.lit("Q"), F.quarter("effective_date"), F.lit(" "), F.date_format("effective_date", "yy"))
    return f.select("company_id", "financial_id", "effective_date", label.alias("quarter"), "cash", F.abs("burn").alias("abs_burn"))


def burn_trend(financials: DataFrame) -> DataFrame:
    """Up or down against the quarter before, only when both are outflows or both inflows."""
    order = ["effective_date", "financial_id"]
    f = financials.where("burn is not null and burn <> 0")
    f = highest_before(f, ["company_id"], order, F.date_trunc("month", "effective_date"), F.struct(*order, "burn"), "_p").withColumn("prior", F.col("_p.burn")).drop("_p")
    same = F.signum("burn") == F.signum("prior")
    return f.withColumn("trend", F.when(same & (F.abs("burn") > F.abs("prior")), "up").when(same & (F.abs("burn") < F.abs("prior")), "down"))


def burn_share(financials: DataFrame) -> DataFrame:
    return financials.where("burn > 0").withColumn("share", F.col("burn") / F.max("burn").over(W.partitionBy("company_id")))


def latest_resource_set(resources: DataFrame) -> DataFrame:
    newest = F.rank().over(W.partitionBy("project_id").orderBy(F.desc("effective_date")))
    return resources.withColumn("_r", newest).where("_r = 1").drop("_r")


def displayed_study(studies: DataFrame, as_of: Column) -> DataFrame:
    """The newest study of a project; future-dated ones only if there is no other."""
    future = F.when(F.col("study_date") > as_of, 1).otherwise(0)
    return top(studies, ["project_id"], [future, F.desc_nulls_last("study_date"), F.desc("study_id")])


def completeness(projects: DataFrame) -> DataFrame:
    """Score from 0 to 1 for rows with the flags below. Fixed weights."""
    weights = {"has_resources": 0.20, "has_primary_commodity": 0.05, "stage_is_advanced": 0.10, "has_study": 0.20, "study_has_production": 0.15, "study_has_npv": 0.15, "has_revaluation": 0.15}
    score = sum((F.when(F.col(c), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return projects.withColumn("score", F.round(score, 2))


def project_revaluation(studies: DataFrame, revals: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """The newest run of each project's newest revaluable study that has any; runs whose price row is gone, or of another tier, don't count."""
    newest = revaluation.latest_revaluable(studies, revals, as_of).select("study_id", "study_date", "needs_review", "review_reason")
    runs = revals.where(F.col("study_confidence_tier").isin("definitive", "indicative")).join(newest, "study_id").join(prices.select(F.col("price_id").alias("price_spot_id"), F.col("fetched_at").alias("spot_fetched_at")), "price_spot_id")
    return top(runs, ["project_id"], [F.desc("computed_at"), F.desc("revaluation_id")])


def project_flags(projects: DataFrame, studies: DataFrame, resources: DataFrame, commodities: DataFrame, revaluations: DataFrame, as_of: Column) -> DataFrame:
    """What the completeness score is made of, for each project; the study is the displayed one."""
    st = displayed_study(studies, as_of).select(
        "project_id", F.lit(True).alias("has_study"), (F.col("mine_life_years").isNotNull() & F.col("annual_production").isNotNull()).alias("study_has_production"), F.col("post_tax_npv").isNotNull().alias("study_has_npv"),
    )
    mark = lambda d, name: d.select("project_id").distinct().withColumn(name, F.lit(True))
    p = projects.join(st, "project_id", "left").join(mark(resources, "has_resources"), "project_id", "left").join(mark(commodities.where("is_primary"), "has_primary_commodity"), "project_id", "left").join(mark(revaluations, "has_revaluation"), "project_id", "left")
    return p.withColumn("stage_is_advanced", F.lower("stage").isin("feasibility", "development", "production"))


def reval_rollup(projects: DataFrame, revaluations: DataFrame) -> DataFrame:
    """Revalued projects, all projects, least coverage and whether any basket is partial, of companies with a revaluation. revaluations has coverage_pct."""
    d = projects.join(revaluations.select("project_id", "coverage_pct"), "project_id", "left").groupBy("company_id").agg(
        F.count("coverage_pct").alias("projects_revalued"), F.count("*").alias("projects_total"), F.min("coverage_pct").alias("min_coverage_pct"), F.bool_or(F.col("coverage_pct") < 100).alias("any_partial_basket"),
    )
    return d.where("projects_revalued > 0")


def capital_latest(capital: DataFrame, financials: DataFrame, companies: DataFrame) -> DataFrame:
    """Shares on issue of each company: of its newest capital snapshot, else of its newest financials that tell them."""
    a = top(capital, ["ticker"], [F.desc_nulls_last("snapshot_date"), F.desc("document_id")]).select("ticker", F.col("shares_basic").cast("double").alias("a"))
    b = top(financials.where("shares_fd is not null"), ["company_id"], [F.desc("effective_date"), F.desc("financial_id")]).select("company_id", F.col("shares_fd").alias("b"))
    d = companies.select("company_id", "ticker").join(a, "ticker", "left").join(b, "company_id", "left").where("a is not null or b is not null")
    return d.select("company_id", F.coalesce("a", "b").alias("shares"), F.when(F.col("a").isNotNull(), "capital").otherwise("financials").alias("source"))


# Labels of types in the feed.
LABELS = {
    "appendix_5b": "Quarterly update", "quarterly_activity": "Quarterly update", "issue_of_securities": "Securities issuance", "placement": "Placement", "resource_update": "Resource update", "study_scoping": "Scoping study",
    "study_pfs": "Pre-feasibility study", "study_dfs": "Feasibility study", "annual_report": "Annual report", "half_year_report": "Half year report", "presentation": "Corporate update",
}


def activity_feed(filings: DataFrame, financials: DataFrame, k: int = 20, shown: int = 10) -> DataFrame:
    """The newest filings of each ticker that say something: of the k newest parsed ones, with their financials, those with a date or a detail, `shown` at most."""
    newest = [F.desc_nulls_last("announcement_date"), F.desc("document_id")]
    recent = top(filings.where("parse_status = 'parsed'"), ["ticker"], newest, k)
    own = top(financials, ["document_id"], [F.desc("effective_date"), F.desc("financial_id")]).select("document_id", "cash", "burn", "shares_fd")
    d = recent.join(own, "document_id", "left")
    kind = F.col("doc_type")
    cash = F.when(F.col("cash").isNotNull(), F.concat(F.lit("cash "), F.bround("cash", 0).cast("long").cast("string")))
    burn = F.when(F.col("burn").isNotNull(), F.concat(F.when(F.col("burn") > 0, "burn ").otherwise("inflow "), F.bround(F.abs("burn"), 0).cast("long").cast("string")))
    detail = F.when(kind.isin(*QUARTERLY), F.concat_ws(". ", cash, burn)).when(kind.isin("issue_of_securities", "placement"), F.coalesce(F.concat(F.bround("shares_fd", 0).cast("long").cast("string"), F.lit(" shares")), F.lit(""))).otherwise(F.coalesce("header", F.lit("")))
    d = d.withColumns({"label": valuation.lookup(kind, LABELS, "Announcement"), "detail": detail}).where("announcement_date is not null or detail <> ''")
    return top(d, ["ticker"], newest, shown).select("ticker", "document_id", "label", "detail", "announcement_date")


def company_meta(companies: DataFrame, meta: DataFrame, projects: DataFrame, commodities: DataFrame) -> DataFrame:
    """A line on each company: of meta(ticker, commodity, flagship_project, jurisdiction), else of its first project. meta is a small lookup."""
    line = lambda *c: F.concat_ws(" · ", *[F.nullif(x, F.lit("")) for x in c])
    given = meta.select("ticker", line(F.initcap("commodity"), F.col("flagship_project"), F.col("jurisdiction")).alias("given"))
    primary = commodities.where("is_primary").groupBy("project_id").agg(F.min("commodity").alias("metal"))
    first = top(projects, ["company_id"], [F.col("project_id")]).join(primary, "project_id", "left")
    own = first.select("company_id", line(F.col("metal"), F.col("project_name"), F.coalesce("state", "country")).alias("own"))
    return companies.join(given, "ticker", "left").join(own, "company_id", "left").select("ticker", F.coalesce(F.nullif("given", F.lit("")), "own", F.lit("")).alias("meta_line"))


def coverage_flags(companies: DataFrame, cash: DataFrame, capital: DataFrame, scored: DataFrame, commodities: DataFrame, filings: DataFrame, least: float = 0.40) -> DataFrame:
    """Which parts of a company's page have content. scored is projects with a completeness score."""
    mark = lambda d, name: d.select("company_id").distinct().withColumn(name, F.lit(True))
    operations = scored.groupBy("company_id").agg((F.max("score") >= least).alias("operations"))
    priced = scored.select("project_id", "company_id").join(commodities.where(F.col("commodity").isin(*valuation.SUPPORTED)), "project_id", "left_semi")
    docs = companies.select("company_id", "ticker").join(filings.select("ticker"), "ticker", "left_semi")
    d = companies.select("company_id", "ticker").join(mark(cash, "financials"), "company_id", "left").join(mark(capital, "capital"), "company_id", "left").join(operations, "company_id", "left").join(mark(priced, "comparison"), "company_id", "left").join(mark(docs, "documents"), "company_id", "left")
    return d.select("ticker", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("financials", "capital", "operations", "comparison", "documents")])


def review_queue(financials: DataFrame, companies: DataFrame, filings: DataFrame, limit: int = 50) -> DataFrame:
    """Flagged snapshots with their filings, the last inserted first."""
    flagged = financials.where("needs_review").join(companies.select("company_id", "ticker"), "company_id").join(filings.select("document_id", "url", "header"), "document_id")
    return flagged.orderBy(F.desc("financial_id")).limit(limit).select("financial_id", "ticker", "effective_date", "review_reason", "url")


def corpus_stats(companies: DataFrame, filings: DataFrame, financials: DataFrame) -> DataFrame:
    """Sizes of everything in one row, each table read once."""
    status = F.col("parse_status")
    a = filings.agg(F.count("*").alias("documents"), *[F.count_if(status == s).alias(f"docs_{s}") for s in ("parsed", "pending", "classified", "failed")])
    b = financials.agg(F.count("*").alias("financials"), F.count_if("needs_review").alias("needs_review"))
    c = companies.agg(F.count("*").alias("companies"))
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").join(c.select("*", one), "_one").drop("_one")


STUDIES = ("study_dfs", "study_pfs", "study_scoping")


def study_coverage_gap(filings: DataFrame) -> DataFrame:
    of = F.col("doc_type").isin(*STUDIES)
    d = filings.agg(F.countDistinct(F.when(of, F.col("ticker"))).alias("with_study_doc"), F.countDistinct(F.when(of & (F.col("parse_status") == "parsed"), F.col("ticker"))).alias("with_parsed_study"))
    return d.withColumn("recoverable_gap", F.col("with_study_doc") - F.col("with_parsed_study"))


def failures_by_class(filings: DataFrame) -> DataFrame:
    return filings.where("parse_status = 'failed'").groupBy(text.failure_class(F.col("parse_error")).alias("failure_class")).agg(F.count("*").alias("n"))


def type_diagnosis(filings: DataFrame, doc_type: str, errors: int = 10, recent: int = 20) -> DataFrame:
    """A type's counts by status, its most frequent errors and its newest filings, as rows of kind, value and n (for filings: the id)."""
    own = filings.where(F.col("doc_type") == doc_type)
    by_status = own.groupBy(F.col("parse_status").alias("value")).agg(F.count("*").alias("n")).select(F.lit("status").alias("kind"), "value", "n")
    worst = own.where("parse_error is not null").groupBy(F.col("parse_error").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(errors)
    newest = own.orderBy(F.desc_nulls_last("announcement_date"), F.desc("document_id")).limit(recent)
    return by_status.unionByName(worst.select(F.lit("error").alias("kind"), "value", "n")).unionByName(newest.select(F.lit("recent").alias("kind"), F.col("ticker").alias("value"), F.col("document_id").alias("n")))


def ingest_health(filings: DataFrame, now_hours: int) -> DataFrame:
    """Totals of one table in one pass."""
    status, due = F.col("parse_status"), F.col("due_in_hours")
    return filings.agg(
        F.count("*").alias("total"), *[F.count_if(status == s).alias(s) for s in ("parsed", "failed", "retry_scheduled", "classified", "pending", "skipped")],
        F.count_if((status == "failed") & (text.failure_class(F.col("parse_error")) == "transient")).alias("failed_transient"),
        F.count_if((status == "retry_scheduled") & (due <= now_hours)).alias("due_now"), F.min(F.when(status == "retry_scheduled", due)).alias("next_due"),
    )


def error_buckets(filings: DataFrame, k: int = 25) -> DataFrame:
    return filings.where("parse_status = 'failed'").groupBy(text.error_bucket(F.col("parse_error")).alias("bucket")).count().orderBy(F.desc("count"), "bucket").limit(k)


def company_doc_counts(companies: DataFrame, filings: DataFrame) -> DataFrame:
    n = filings.groupBy("ticker").agg(F.count("*").alias("n_docs"), F.count_if(F.col("parse_status") == "parsed").alias("n_parsed"))
    return companies.join(n, "ticker", "left").select("ticker", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_parsed", F.lit(0)).alias("n_parsed"))


def apply_failures(filings: DataFrame) -> DataFrame:
    """The next state of failed filings: transient ones wait and count, until the retries are used up."""
    kind = text.failure_class(F.col("parse_error"))
    again = (kind == "transient") & (F.col("retry_count") < text.MAX_RETRIES)
    f = filings.where("parse_error is not null")
    return f.select(
        "document_id", kind.alias("failure_class"), F.when(again, "retry_scheduled").otherwise("failed").alias("new_status"),
        F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("new_count"), F.when(again, text.retry_wait_hours(F.col("retry_count"))).alias("wait_hours"),
        F.when((kind == "transient") & ~again, F.concat(F.col("parse_error"), F.lit(":retries_exhausted"))).otherwise(F.col("parse_error")).alias("new_error"),
    )


def floor_stages(projects: DataFrame, studies: DataFrame) -> DataFrame:
    """Projects with the stage that their most advanced study implies at least."""
    best = studies.groupBy("project_id").agg(F.min_by("study_stage", valuation.stage_rank(valuation.study_floor(F.lit("unknown"), valuation.tier_of(F.col("study_stage"))))).alias("best"))
    p = projects.join(best, "project_id", "left")
    new = valuation.study_floor(F.col("stage"), valuation.tier_of(F.col("best")))
    return p.select("project_id", "stage", new.alias("new_stage"), (new != F.col("stage")).alias("floor_won"))
