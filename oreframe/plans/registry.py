"""Registered queries of the filings engine, with independent SQL for each.

The views they share are in bind.py; every computed column has the same name in
both. as-of times are literals, so results don't depend on the day. This module has
scalars and company and ingest queries; the others are in the modules it imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import valuation as v
from ..operators import company, prices
from .base import BAD, FACTOR, ORACLE_SQL, QUERIES, STAGE_RANK, TAX, TIER, TRANSIENT, day, now, query, rounded
from .bind import view

LATEST = "select commodity, arg_max(price_usd, (fetched_at, price_id)) as price_usd, arg_max(price_id, (fetched_at, price_id)) as price_id from commodity_prices where fetched_at <= timestamp '2024-01-29 12:00:00' group by commodity"


@query("select distinct discount_rate_pct, mine_life_years, case when discount_rate_pct > 0 then round_even((1 - pow(1 + discount_rate_pct / 100, -mine_life_years)) / (discount_rate_pct / 100), 4) end as annuity from studies")
def annuity(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "studies").select("discount_rate_pct", "mine_life_years").distinct().withColumn("annuity", v.annuity(F.col("discount_rate_pct"), F.col("mine_life_years")))


@query(f"select study_id, {TAX} as tax, case when tax_rate_pct = 0 then 'tax_rate_zero_pct_kept' when tax_rate_pct < 1 then 'tax_rate_fraction_scaled_' || regexp_replace(printf('%.4f', round_even(tax_rate_pct, 4)), '\\.?0+$', '') || '_to_' || printf('%.1f', {TAX}) || 'pct' end as warning from studies")
def tax_norm(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "studies").select("study_id", v.tax_rate(F.col("tax_rate_pct")).alias("tax"), v.tax_warning(F.col("tax_rate_pct")).alias("warning"))


@query(f"select study_id, leg, cast({FACTOR} as int) as factor, {BAD} as error from study_commodities")
def production_magnitude(s: SparkSession, d: str) -> DataFrame:
    metal, made = F.col("commodity"), F.col("annual_production")
    return view(s, d, "study_commodities").select("study_id", "leg", v.production_factor(metal, made).alias("factor"), v.production_error(metal, made).alias("error"))


@query("select study_id, round(case when date_diff('day', study_date, date '2001-09-01') > 0 then greatest(mine_life_years - date_diff('day', study_date, date '2001-09-01') / 365.25, 0.0) else mine_life_years end, 4) as remaining from studies")
def remaining_life(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "studies").select("study_id", rounded(v.remaining_life(F.col("mine_life_years"), v.elapsed_years(F.col("study_date"), day())), 4).alias("remaining"))


@query("select study_id, round(date_diff('day', study_date, date '2001-09-01') / 365.25, 4) as age, date_diff('day', study_date, date '2001-09-01') / 365.25 > 3 as stale from studies")
def study_age(s: SparkSession, d: str) -> DataFrame:
    age = F.datediff(day(), F.col("study_date")) / 365.25
    return view(s, d, "studies").select("study_id", rounded(age, 4).alias("age"), (age > 3).alias("stale"))


@query(f"select study_stage, {TIER} as tier, count(*) as n from studies group by all")
def tier_map(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "studies").groupBy("study_stage", v.tier_of(F.col("study_stage")).alias("tier")).agg(F.count("*").alias("n"))


@query(LATEST)
def latest_price(s: SparkSession, d: str) -> DataFrame:
    return prices.latest_price(view(s, d, "commodity_prices"), now()).select("commodity", "price_usd", "price_id")


@query("""with l as (select * from commodity_prices where commodity = 'Ag'), r as (select series, fetched_at, arg_max(price_usd, price_id) as spot from commodity_prices where commodity = 'Au' group by all)
    select l.price_id, l.series, l.price_usd, r.spot from l asof join r on l.series = r.series and l.fetched_at >= r.fetched_at""")
def asof_align(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "commodity_prices")
    right = p.where("commodity = 'Au'").groupBy("series", "fetched_at").agg(F.max_by("price_usd", "price_id").alias("spot"))
    left = p.where("commodity = 'Ag'").select("price_id", "series", "price_usd", "fetched_at")
    return prices.asof_align(left, right, ["series"], "fetched_at", "spot").select("price_id", "series", "price_usd", "spot")


DAILY = "select commodity, cast(fetched_at as date) as day, arg_max(price_usd, (fetched_at, price_id)) as close from commodity_prices group by all"


@query(f"with daily as ({DAILY}) select commodity, day, close, round(close / first_value(close) over (partition by commodity order by day) * 100, 4) as rebased from daily")
def rebase_100(s: SparkSession, d: str) -> DataFrame:
    return prices.rebase(prices.daily_close(view(s, d, "commodity_prices"))).withColumn("rebased", rounded("rebased", 4))


@query("select company_id, financial_id, effective_date, cash, burn from (select *, row_number() over (partition by company_id order by effective_date desc, financial_id desc) as r from company_financials) where r = 1")
def financials_latest(s: SparkSession, d: str) -> DataFrame:
    return company.financials_latest(view(s, d, "company_financials")).select("company_id", "financial_id", "effective_date", "cash", "burn")


@query("select financial_id, case when sign(burn) = sign(prior) and abs(burn) > abs(prior) then 'up' when sign(burn) = sign(prior) and abs(burn) < abs(prior) then 'down' end as trend from (select *, lag(burn) over (partition by company_id order by effective_date, financial_id) as prior from company_financials where burn is not null and burn <> 0)")
def burn_trend(s: SparkSession, d: str) -> DataFrame:
    return company.burn_trend(view(s, d, "company_financials")).select("financial_id", "trend")


@query("select financial_id, round(burn / max(burn) over (partition by company_id), 6) as share from company_financials where burn > 0")
def burn_share(s: SparkSession, d: str) -> DataFrame:
    return company.burn_share(view(s, d, "company_financials")).select("financial_id", rounded("share", 6).alias("share"))


@query("select project_id, resource_id from (select *, rank() over (partition by project_id order by effective_date desc) as r from resources) where r = 1")
def latest_resources(s: SparkSession, d: str) -> DataFrame:
    return company.latest_resource_set(view(s, d, "resources")).select("project_id", "resource_id")


@query("select project_id, study_id from (select *, row_number() over (partition by project_id order by coalesce(study_date > date '2000-01-01', false), study_date desc nulls last, study_id desc) as r from studies) where r = 1")
def displayed_study(s: SparkSession, d: str) -> DataFrame:
    return company.displayed_study(view(s, d, "studies"), day("2000-01-01")).select("project_id", "study_id")


@query(f"""with best as (select project_id, min(case when {TIER} in ('definitive', 'indicative') then 4 else 5 end) as f from studies group by project_id), k as (select p.project_id, stage, {STAGE_RANK} as r, f from projects p left join best b on b.project_id = p.project_id)
    select project_id, stage, case least(r, f) when 1 then 'production' when 2 then 'care_and_maintenance' when 3 then 'development' when 4 then 'feasibility' when 5 then 'advanced_exploration' when 6 then 'exploration' else 'unknown' end as new_stage, coalesce(f < r, false) as floor_won from k""")
def study_floor(s: SparkSession, d: str) -> DataFrame:
    return company.floor_stages(view(s, d, "projects"), view(s, d, "studies"))


@query(f"select document_id, case when header is null then null when regexp_matches(lower(header), '\\b(scoping|pea)\\b') then 'conceptual' when regexp_matches(lower(header), '\\b(pre[-\\s]?feasibility|prefeasibility|pfs)\\b') then 'indicative' when regexp_matches(lower(header), '\\b(definitive\\s+feasibility|dfs|bfs|bankable\\s+feasibility|feasibility\\s+study)\\b') then 'definitive' end as tier from filings")
def header_tier(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "filings").select("document_id", t.header_tier(F.col("header")).alias("tier"))


@query(f"select document_id, case when {TRANSIENT} then 'transient' else 'permanent' end as failure_class from filings")
def failure_class(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "filings").select("document_id", t.failure_class(F.col("parse_error")).alias("failure_class"))


@query(f"""with f as (select *, {TRANSIENT} as tr from filings where parse_error is not null)
    select document_id, case when tr then 'transient' else 'permanent' end as failure_class, case when tr and retry_count < 5 then 'retry_scheduled' else 'failed' end as new_status, case when tr and retry_count < 5 then retry_count + 1 else retry_count end as new_count,
    case when tr and retry_count < 5 then cast(least(pow(2, retry_count), 24) as int) end as wait_hours, case when tr and retry_count >= 5 then parse_error || ':retries_exhausted' else parse_error end as new_error from f""")
def failure_transition(s: SparkSession, d: str) -> DataFrame:
    return company.apply_failures(view(s, d, "filings"))


@query(f"select count(*) as total, count(*) filter (where parse_status = 'parsed') as parsed, count(*) filter (where parse_status = 'failed') as failed, count(*) filter (where parse_status = 'pending') as pending, count(*) filter (where parse_status = 'classified') as classified, count(*) filter (where parse_status = 'skipped') as skipped, count(*) filter (where parse_status = 'retry_scheduled') as retry_scheduled, count(*) filter (where parse_status = 'failed' and {TRANSIENT}) as failed_transient, count(*) filter (where parse_status = 'retry_scheduled' and due_in_hours <= 24) as due_now, min(due_in_hours) filter (where parse_status = 'retry_scheduled') as next_due from filings")
def ingest_health(s: SparkSession, d: str) -> DataFrame:
    return company.ingest_health(view(s, d, "filings"), 24)


@query("""with f as (select string_split_regex(coalesce(parse_error, 'none'), '[:(]') as p from filings where parse_status = 'failed')
    select case when trim(p[1]) in ('study_parse_error', 'llm_api_error') and coalesce(trim(p[2]), '') <> '' then trim(p[1]) || ':' || substr(trim(p[2]), 1, 40) else substr(trim(p[1]), 1, 60) end as bucket, count(*) as count from f group by 1 order by 2 desc, 1 limit 25""")
def error_buckets(s: SparkSession, d: str) -> DataFrame:
    return company.error_buckets(view(s, d, "filings"))


@query("select c.ticker, count(f.document_id) as n_docs, count(f.document_id) filter (where parse_status = 'parsed') as n_parsed from companies c left join filings f on f.ticker = c.ticker group by c.ticker")
def company_doc_counts(s: SparkSession, d: str) -> DataFrame:
    return company.company_doc_counts(view(s, d, "companies"), view(s, d, "filings"))


from . import quality_queries, reval, state_queries, text_queries, view_queries  # noqa: E402, F401  they register their queries
