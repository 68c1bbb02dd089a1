"""Queries of prices, the screener, company snapshots and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import valuation as v
from ..operators import company, prices, screen
from .base import JUNK, REVALUABLE, STAGE_RANK, TRANSIENT, day, now, query, rounded
from .bind import view
from .quality_queries import _capital
from .text_queries import SECURITIES

TIER_RANK = "case study_confidence_tier when 'definitive' then 0 when 'indicative' then 1 else 2 end"
DAILY = "select commodity, cast(fetched_at as date) as day, arg_max(price_usd, (fetched_at, price_id)) as close from commodity_prices group by all"


@query("select commodity, arg_max(price_usd, (fetched_at, price_id)) as price_usd, arg_max(price_id, (fetched_at, price_id)) as price_id from commodity_prices where fetched_at <= timestamp '2024-01-29 12:00:00' and fetched_at >= timestamp '2024-01-29 09:00:00' group by commodity")
def latest_price_fresh(s: SparkSession, d: str) -> DataFrame:
    return prices.latest_price(view(s, d, "commodity_prices"), now(), ttl_hours=3).select("commodity", "price_usd", "price_id")


SYMBOL = "case event_id % 9 when 0 then 'GC=F' when 1 then 'SI=F' when 2 then 'HG=F' when 3 then 'PA=F' when 4 then 'PL=F' when 5 then 'UX=F' when 6 then 'AUDUSD=X' else 'ZZ=F' end"


@query(f"select event_id, case {SYMBOL} when 'GC=F' then 'Au' when 'SI=F' then 'Ag' when 'HG=F' then 'Cu' when 'PA=F' then 'Pd' when 'PL=F' then 'Pt' when 'UX=F' then 'U3O8' when 'AUDUSD=X' then 'AUDUSD' end as commodity, case when {SYMBOL} in ('HG=F', 'UX=F') then 'USD/lb' when {SYMBOL} = 'AUDUSD=X' then 'USD_per_AUD' when {SYMBOL} <> 'ZZ=F' then 'USD/oz' end as unit, case when {SYMBOL} <> 'ZZ=F' then value end as price_usd, case when {SYMBOL} = 'ZZ=F' then 'no_commodity_for_symbol:ZZ=F' end as error from events")
def symbol_map(s: SparkSession, d: str) -> DataFrame:
    quotes = s.read.parquet(f"{d}/events.parquet").select("event_id", F.expr(SYMBOL).alias("symbol"), F.col("value").alias("price"))
    return prices.symbol_map(quotes).select("event_id", "commodity", "unit", "price_usd", "error")


@query(f"with daily as ({DAILY}) select '6m' as range, commodity, day, close from daily where day > date '2024-01-20' - 182 and day <= date '2024-01-20' union all select '3y', commodity, cast(date_trunc('week', day) as date), arg_max(close, day) from daily where day > date '2024-01-20' - 1095 and day <= date '2024-01-20' group by 2, 3")
def range_window(s: SparkSession, d: str) -> DataFrame:
    daily = prices.daily_close(view(s, d, "commodity_prices"))
    one = lambda r: prices.range_window(daily, r, day("2024-01-20")).select(F.lit(r).alias("range"), "commodity", "day", "close")
    return one("6m").unionByName(one("3y"))


ACTIVE = f"active as (select p.*, project_id in (select project_id from studies) as has_study from projects p where project_id in (select project_id from studies) or (project_id in (select project_id from resources) and not {JUNK}))"
LATEST = f"dated as (select *, study_confidence_tier as tier, coalesce(study_date, announcement_date) as date from studies), newest as (select * from (select *, row_number() over (partition by project_id order by date desc nulls last, {TIER_RANK}, study_id desc) as r from dated) where r = 1), cnewest as (select * from (select * exclude (r), row_number() over (partition by company_id order by date desc nulls last, {TIER_RANK}, study_id desc) as r from newest) where r = 1)"
NAMES = "coalesce(array_to_string(list_sort(list(distinct {0}) filter (where {0} is not null)), ','), '') as {1}"
ROLLUP = f"""{ACTIVE}, {LATEST}, total as (select company_id, count(*) as n_projects from projects group by company_id),
    live as (select company_id, count(*) as n_active, {NAMES.format('stage', 'stages')}, {NAMES.format('country', 'countries')}, {NAMES.format('state', 'states')}, {NAMES.format('region', 'regions')}, arg_min(stage, {STAGE_RANK}) as most_advanced, min({STAGE_RANK}) as rank from active group by company_id),
    st as (select company_id, count(distinct project_id) as n_with_study, bool_or({REVALUABLE}) as has_dfs_pfs from studies group by company_id),
    rolled as (select c.company_id, ticker, company_name, n_projects, n_active, coalesce(n_with_study, 0) as n_with_study, stages, countries, states, regions, most_advanced, rank, coalesce(has_dfs_pfs, false) as has_dfs_pfs, n.study_stage as latest_study_stage, n.date as latest_study_date
        from companies c join live l on l.company_id = c.company_id left join total t on t.company_id = c.company_id left join st on st.company_id = c.company_id left join cnewest n on n.company_id = c.company_id)"""
PRIMARIES = "primaries as (select company_id, array_to_string(list_sort(list(distinct commodity)), ',') as commodities from project_commodities join active using (project_id) where is_primary group by company_id)"
RUNS = f"select r.*, s.study_stage, s.study_date, s.reporting_currency, s.needs_review, s.review_reason, s.study_confidence_tier as stier from revals r left join studies s on s.study_id = r.study_id"
FLAGS = """flags as (select *, coalesce(try_cast(split_part(list_filter(from_json(warnings, '["VARCHAR"]'), lambda w: starts_with(w, 'coverage_pct:'))[1], ':', 2) as double), 100.0) as coverage_pct, round_even(date_diff('day', study_date, date '2001-09-01') / 365.25, 1) as study_age_years,
    case when needs_review then nullif(array_to_string(list_filter(list_transform(string_split(coalesce(review_reason, ''), ';'), lambda x: trim(x)), lambda x: contains(x, 'npv_ge_pre') or contains(x, 'implied_tax_gap') or contains(x, 'npv_post')), '; '), '') end as review_doubts from stands)"""
STANDS = f"stands as (select * from (select *, row_number() over (partition by company_id order by case when stier in ('definitive', 'indicative') then 0 else 1 end, study_date desc nulls last, computed_at desc, revaluation_id desc) as k from ({RUNS})) where k = 1), {FLAGS}"
SCREEN = f"{ROLLUP}, {PRIMARIES}, {STANDS}, screened as (select r.*, coalesce(commodities, '') as commodities, npv_uplift, npv_uplift_pct, coverage_pct, coalesce(npv_dfs < 50, case when f.company_id is not null then false end) as low_base from rolled r left join primaries p on p.company_id = r.company_id left join flags f on f.company_id = r.company_id)"
COLUMNS = ("ticker", "n_projects", "n_active", "n_with_study", "stages", "countries", "states", "regions", "most_advanced", "has_dfs_pfs", "latest_study_stage", "latest_study_date")


def _active(s: SparkSession, d: str) -> DataFrame:
    return screen.active_projects(view(s, d, "projects"), view(s, d, "studies"), view(s, d, "resources"))


def _rollup(s: SparkSession, d: str) -> DataFrame:
    return screen.company_rollup(view(s, d, "companies"), view(s, d, "projects"), view(s, d, "studies"), _active(s, d))


def _flagged(s: SparkSession, d: str) -> DataFrame:
    return screen.signal_flags(screen.company_revaluation(view(s, d, "revals"), view(s, d, "studies")), day())


def _screen(s: SparkSession, d: str) -> DataFrame:
    return screen.screen(_rollup(s, d), screen.primary_commodities(_active(s, d), view(s, d, "project_commodities")), _flagged(s, d))


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


@query(f"with {ACTIVE} select project_id, company_id, has_study from active")
def active_projects(s: SparkSession, d: str) -> DataFrame:
    return _active(s, d).select("project_id", "company_id", "has_study")


@query(f"with {LATEST} select project_id, study_id, study_stage, tier, date from newest")
def latest_study(s: SparkSession, d: str) -> DataFrame:
    return screen.latest_study(view(s, d, "studies")).select("project_id", "study_id", "study_stage", "tier", "date")


@query(f"with {LATEST} select company_id, study_id, study_stage, date from cnewest")
def company_latest_study(s: SparkSession, d: str) -> DataFrame:
    return screen.company_latest_study(view(s, d, "studies")).select("company_id", "study_id", "study_stage", "date")


@query(f"with {ROLLUP} select {', '.join(COLUMNS)} from rolled")
def company_rollup(s: SparkSession, d: str) -> DataFrame:
    return _joined(_rollup(s, d), "stages", "countries", "states", "regions").select(*COLUMNS)


@query(f"with {ACTIVE}, {PRIMARIES} select company_id, commodities from primaries")
def primary_commodities(s: SparkSession, d: str) -> DataFrame:
    return _joined(screen.primary_commodities(_active(s, d), view(s, d, "project_commodities")), "commodities")


@query(f"with {STANDS} select company_id, revaluation_id, study_id from stands")
def company_reval(s: SparkSession, d: str) -> DataFrame:
    return screen.company_revaluation(view(s, d, "revals"), view(s, d, "studies")).select("company_id", "revaluation_id", "study_id")


@query(f"with {STANDS} select company_id, coverage_pct, coverage_pct < 100 as is_partial_basket, study_age_years, coalesce(study_age_years > 3, false) as is_stale_study, coalesce(price_dfs < price_spot / 2, false) as deck_far_below_spot, review_doubts, review_doubts is not null as study_needs_review, coalesce(npv_dfs < 50, false) as low_base from flags")
def signal_flags(s: SparkSession, d: str) -> DataFrame:
    return _flagged(s, d).select("company_id", "coverage_pct", "is_partial_basket", "study_age_years", "is_stale_study", "deck_far_below_spot", "review_doubts", "study_needs_review", "low_base")


@query(f"with {ACTIVE} select company_id, stage, count(*) as n from active group by all")
def stage_profile(s: SparkSession, d: str) -> DataFrame:
    return screen.stage_breakdown(_active(s, d))


SHOWN = ("ticker", "n_active", "most_advanced", "commodities", "countries", "npv_uplift", "npv_uplift_pct", "coverage_pct", "low_base")
RANKED = "ticker, n_active, most_advanced, commodities, countries, round(npv_uplift, 4) as npv_uplift, npv_uplift_pct, coverage_pct, low_base"


def _shown(df: DataFrame) -> DataFrame:
    return _joined(df, "commodities", "countries").select(*SHOWN).withColumn("npv_uplift", rounded("npv_uplift", 4))


@query(f"with {SCREEN} select {RANKED} from screened where n_active > 1 and most_advanced = 'production' and contains(commodities, 'Au') and contains(countries, 'Australia') and latest_study_date >= date '1999-01-01' and has_dfs_pfs")
def screen_filter(s: SparkSession, d: str) -> DataFrame:
    return _shown(screen.screen_filter(_screen(s, d), stage="production", commodity="Au", country="Australia", recent_since="1999-01-01", study_after="1998-06-01", supported_only=True).where("n_active > 1"))


@query(f"with {SCREEN}, total as (select count(*) as total from screened), ranked as (select 'most_advanced_stage_desc' as sort, * from (select * from screened order by rank, ticker limit 200) union all select 'project_count', * from (select * from screened order by n_active desc, ticker limit 200) union all select 'ticker', * from (select * from screened order by ticker limit 200) union all select 'uplift_abs_desc', * from (select * from screened order by npv_uplift desc nulls last, ticker limit 200) union all select 'uplift_pct_desc', * from (select * from screened order by npv_uplift_pct desc nulls last, ticker limit 200)) select sort, total, {RANKED} from ranked, total".replace("total as (select count(*) as total from screened)", "counted as (select count(*) as total from screened)").replace("from ranked, total", "from ranked, counted"))
def screen_rank(s: SparkSession, d: str) -> DataFrame:
    table = _screen(s, d)
    ranked = _joined(screen.rank_screens(table), "commodities", "countries").withColumn("npv_uplift", rounded("npv_uplift", 4))
    return ranked.select("sort", table.agg(F.count("*")).scalar().alias("total"), *SHOWN)


@query("select ticker, company_name from companies where contains(lower(ticker), 't12') or contains(lower(company_name), 't12') order by starts_with(lower(ticker), 't12') desc, ticker limit 8")
def screen_search(s: SparkSession, d: str) -> DataFrame:
    return screen.screen_search(view(s, d, "companies"), "T12 ").select("ticker", "company_name")


@query(f"with {SCREEN} select ticker from screened where n_with_study > 0 and (contains(lower(ticker), '1') or contains(lower(company_name), '1'))")
def screen_visible(s: SparkSession, d: str) -> DataFrame:
    return screen.visible(_screen(s, d), "1", hide_empty=True).select("ticker")


@query(f"with {SCREEN} select 'country' as facet, v as value, count(*) as n from (select unnest(string_split(countries, ',')) as v from screened where countries <> '') group by v union all select 'commodity', v, count(*) from (select unnest(string_split(commodities, ',')) as v from screened where commodities <> '') group by v")
def screen_facets(s: SparkSession, d: str) -> DataFrame:
    return screen.screen_facets(_screen(s, d))


CHOICES = {"country": "list_contains(string_split(countries, ','), 'Australia')", "commodity": "list_contains(string_split(commodities, ','), 'Au')", "stage": "most_advanced = 'production'"}
_EACH = {"country": "string_split(countries, ',')", "state": "string_split(states, ',')", "region": "string_split(regions, ',')", "commodity": "string_split(commodities, ',')", "stage": "[most_advanced]"}


@query(f"with {SCREEN} " + " union all ".join(f"select '{f}' as facet, v as value, count(*) as n from (select unnest({x}) as v from screened where {' and '.join(c for g, c in CHOICES.items() if g != f)}) where v <> '' group by v" for f, x in _EACH.items()))
def facets_under_filter(s: SparkSession, d: str) -> DataFrame:
    return screen.facets_under_filter(_screen(s, d), {"country": "Australia", "commodity": "Au", "stage": "production"})


@query("select study_id, case when a <= 1.5 then 'fresh' when a <= 3 then 'ageing' when a > 3 then 'stale' end as bucket, case when a < 0 then null when a < 3 then 'fresh' when a < 5 then 'aging' when a >= 5 then 'stale' end as vintage from (select study_id, date_diff('day', study_date, date '2000-09-01') / 365.25 as a from studies)")
def age_bucket(s: SparkSession, d: str) -> DataFrame:
    age = F.datediff(day("2000-09-01"), F.col("study_date")) / 365.25
    return view(s, d, "studies").select("study_id", screen.age_bucket(age).alias("bucket"), screen.vintage(age).alias("vintage"))


@query(f"""with {FLAGS.replace('stands', 'pstands')}, s as (select project_id, count(*) as n_studies, arg_max(study_id, (coalesce(study_date, date '0001-01-01'), study_id)) as latest_study_id from studies group by project_id), r as (select project_id, count(*) as n_resources, arg_max(resource_id, (effective_date, resource_id)) as latest_resource_id from resources group by project_id),
    c as (select project_id, min(commodity) filter (where is_primary) as primary_commodity, array_to_string(list_sort(list(distinct commodity)), ',') as all_commodities from project_commodities group by project_id), m as (select project_id, count(distinct commodity) > 1 as multi from (select project_id, commodity from project_commodities union select project_id, commodity from resources) group by project_id),
    n as (select ticker, count(*) as n_documents from filings group by ticker), i as (select project_id, arg_max(case o % 2 when 0 then 'high' else 'low' end, o) as conf from (select project_id, study_id as o from studies) group by project_id)
    select p.project_id, ticker, latest_study_id, latest_resource_id, revaluation_id, study_age_years, coalesce(n_studies, 0) as n_studies, coalesce(n_resources, 0) as n_resources, coalesce(n_documents, 0) as n_documents, coalesce(n_studies, 0) > 0 or coalesce(n_resources, 0) > 0 as is_active, primary_commodity, coalesce(all_commodities, '') as all_commodities, coalesce(multi, false) as is_multi_commodity, case when stage_source = 'inferred' then conf end as stage_confidence
    from projects p join companies using (company_id) left join s on s.project_id = p.project_id left join r on r.project_id = p.project_id left join c on c.project_id = p.project_id left join m on m.project_id = p.project_id left join flags f on f.project_id = p.project_id left join n using (ticker) left join i on i.project_id = p.project_id where not {JUNK} or n_studies > 0""".replace("with flags", f"with pstands as (select * from (select *, row_number() over (partition by project_id order by case when stier in ('definitive', 'indicative') then 0 else 1 end, study_date desc nulls last, computed_at desc, revaluation_id desc) as k from ({RUNS})) where k = 1), flags", 1))
def project_detail(s: SparkSession, d: str) -> DataFrame:
    st = view(s, d, "studies")
    inferences = st.select("project_id", F.when(F.col("study_id") % 2 == 0, "high").otherwise("low").alias("stage_confidence"), F.col("study_id").alias("inferred_at"))
    out = screen.project_detail(view(s, d, "projects"), st, view(s, d, "resources"), view(s, d, "project_commodities"), view(s, d, "revals"), view(s, d, "companies"), view(s, d, "filings"), inferences, day())
    out = out.withColumns({"latest_resource_id": F.col("latest_resource.resource_id"), "all_commodities": F.coalesce(F.array_join("all_commodities", ","), F.lit(""))})
    return out.select("project_id", "ticker", "latest_study_id", "latest_resource_id", "revaluation_id", "study_age_years", "n_studies", "n_resources", "n_documents", "is_active", "primary_commodity", "all_commodities", "is_multi_commodity", "stage_confidence")


@query("select company_id, financial_id, effective_date, 'Q' || quarter(effective_date) || ' ' || strftime(effective_date, '%y') as quarter, cash, abs(burn) as abs_burn from company_financials where doc_type in ('appendix_5b', 'quarterly_activity') and cash is not null")
def cash_history(s: SparkSession, d: str) -> DataFrame:
    return company.cash_history(view(s, d, "company_financials"))


NEWEST_FIN = "select * from (select *, row_number() over (partition by company_id order by effective_date desc, financial_id desc) as r from company_financials) where r = 1"


@query(f"select company_id, financial_id, round(case when cash <> 0 and burn > 0 then cash / burn end, 4) as quarters, case when cash <> 0 and burn > 0 then '~' || cast(round_even(cash / burn, 0) as bigint) || ' quarters of runway' when cash <> 0 and burn < 0 then 'Net cash positive' end as label from ({NEWEST_FIN})")
def runway(s: SparkSession, d: str) -> DataFrame:
    cash, burn = F.col("cash"), F.col("burn")
    return company.financials_latest(view(s, d, "company_financials")).select("company_id", "financial_id", rounded(v.runway_quarters(cash, burn), 4).alias("quarters"), v.runway_label(cash, burn).alias("label"))


@query("select company_id, financial_id, effective_date, cash, burn, shares_fd from company_financials")
def financials_history(s: SparkSession, d: str) -> DataFrame:
    return company.financials_history(view(s, d, "company_financials")).select("company_id", "financial_id", "effective_date", "cash", "burn", "shares_fd")


CAPITAL = f"""{SECURITIES}, good as (select document_id, cast(sum(total_on_issue) filter (where kind = 'share') as double) as basic from securities group by document_id having sum(total_on_issue) filter (where kind = 'share') > 0), capped as (select ticker, arg_max(basic, (coalesce(announcement_date, date '0001-01-01'), g.document_id)) as a from good g join filings f on f.document_id = g.document_id group by ticker),
    fins as (select company_id, arg_max(shares_fd, (effective_date, financial_id)) as b from company_financials where shares_fd is not null group by company_id), caps as (select c.company_id, coalesce(a, b) as shares, case when a is not null then 'capital' else 'financials' end as source from companies c left join capped k on k.ticker = c.ticker left join fins n on n.company_id = c.company_id where a is not null or b is not null)"""


def _caps(s: SparkSession, d: str) -> DataFrame:
    return company.capital_latest(_capital(s, d)[1], view(s, d, "company_financials"), view(s, d, "companies"))


@query(f"with {CAPITAL} select * from caps")
def capital_latest(s: SparkSession, d: str) -> DataFrame:
    return _caps(s, d)


@query("""with recent as (select * from (select *, row_number() over (partition by ticker order by announcement_date desc nulls last, document_id desc) as r from filings where parse_status = 'parsed') where r <= 20), fin as (select * from (select *, row_number() over (partition by document_id order by effective_date desc, financial_id desc) as r from company_financials) where r = 1),
    told as (select ticker, e.document_id, announcement_date, case e.doc_type when 'appendix_5b' then 'Quarterly update' when 'quarterly_activity' then 'Quarterly update' when 'issue_of_securities' then 'Securities issuance' when 'resource_update' then 'Resource update' when 'study_scoping' then 'Scoping study' when 'study_pfs' then 'Pre-feasibility study' when 'study_dfs' then 'Feasibility study' when 'presentation' then 'Corporate update' else 'Announcement' end as label,
        case when e.doc_type in ('appendix_5b', 'quarterly_activity') then concat_ws('. ', case when cash is not null then 'cash ' || cast(round_even(cash, 0) as bigint) end, case when burn is not null then case when burn > 0 then 'burn ' else 'inflow ' end || cast(round_even(abs(burn), 0) as bigint) end) when e.doc_type = 'issue_of_securities' then coalesce(cast(round_even(shares_fd, 0) as bigint) || ' shares', '') else coalesce(header, '') end as detail
        from recent e left join fin on fin.document_id = e.document_id)
    select ticker, document_id, label, detail, announcement_date from (select *, row_number() over (partition by ticker order by announcement_date desc nulls last, document_id desc) as k from told where announcement_date is not null or detail <> '') where k <= 10""")
def activity_feed(s: SparkSession, d: str) -> DataFrame:
    return company.activity_feed(view(s, d, "filings"), view(s, d, "company_financials"))


PROJECT_REVAL = f"""ranked as (select *, row_number() over (partition by project_id order by case when study_date > date '2000-06-01' then 1 else 0 end, study_date desc nulls last, study_id desc) as rn from studies where {REVALUABLE} and study_id in (select study_id from revals)),
    preval as (select * from (select r.*, row_number() over (partition by r.project_id order by computed_at desc, revaluation_id desc) as k from revals r join ranked n on n.study_id = r.study_id and n.rn = 1 join commodity_prices p on p.price_id = r.price_spot_id where r.study_confidence_tier in ('definitive', 'indicative')) where k = 1)"""


def _project_revals(s: SparkSession, d: str) -> DataFrame:
    return company.project_revaluation(view(s, d, "studies"), view(s, d, "revals"), view(s, d, "commodity_prices"), day("2000-06-01"))


@query(f"with {PROJECT_REVAL} select project_id, revaluation_id, study_id from preval")
def project_reval(s: SparkSession, d: str) -> DataFrame:
    return _project_revals(s, d).select("project_id", "revaluation_id", "study_id")


SCORED = f"""{PROJECT_REVAL}, shown as (select * from (select *, row_number() over (partition by project_id order by case when study_date > date '2000-06-01' then 1 else 0 end, study_date desc nulls last, study_id desc) as k from studies) where k = 1),
    scored as (select p.project_id, p.company_id, round(case when p.project_id in (select project_id from resources) then 0.2 else 0 end + case when p.project_id in (select project_id from project_commodities where is_primary) then 0.05 else 0 end + case when stage in ('feasibility', 'development', 'production') then 0.1 else 0 end + case when h.study_id is not null then 0.2 else 0 end
        + case when h.mine_life_years is not null and h.annual_production is not null then 0.15 else 0 end + case when h.post_tax_npv is not null then 0.15 else 0 end + case when v.project_id is not null then 0.15 else 0 end, 2)::double as score from projects p left join shown h on h.project_id = p.project_id left join preval v on v.project_id = p.project_id)"""


def _scored(s: SparkSession, d: str) -> DataFrame:
    flags = company.project_flags(view(s, d, "projects"), view(s, d, "studies"), view(s, d, "resources"), view(s, d, "project_commodities"), _project_revals(s, d), day("2000-06-01"))
    return company.completeness(flags)


@query(f"with {SCORED} select project_id, score from scored")
def completeness(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select("project_id", "score")


@query(f"""with {PROJECT_REVAL}, covered as (select p.company_id, p.project_id, case when v.project_id is not null then coalesce(try_cast(split_part(list_filter(from_json(warnings, '["VARCHAR"]'), lambda w: starts_with(w, 'coverage_pct:'))[1], ':', 2) as double), 100.0) end as c from projects p left join preval v on v.project_id = p.project_id)
    select company_id, count(c) as projects_revalued, count(*) as projects_total, min(c) as min_coverage_pct, bool_or(c < 100) as any_partial_basket from covered group by company_id having count(c) > 0""")
def reval_rollup(s: SparkSession, d: str) -> DataFrame:
    own = _project_revals(s, d).withColumn("coverage_pct", screen.coverage_of(F.col("warnings")))
    return company.reval_rollup(view(s, d, "projects"), own)


@query("""with meta as (select 'T' || s_suppkey as ticker, case s_suppkey % 3 when 0 then '' else 'gold' end as commodity, case s_suppkey % 2 when 0 then s_name else '' end as flagship, case s_suppkey % 6 when 0 then '' when 3 then '' else 'WA' end as jurisdiction from supplier),
    given as (select ticker, concat_ws(' · ', nullif(case commodity when 'gold' then 'Gold' else '' end, ''), nullif(flagship, ''), nullif(jurisdiction, '')) as line from meta), first as (select * from (select *, row_number() over (partition by company_id order by project_id) as r from projects) where r = 1), prim as (select project_id, min(commodity) as metal from project_commodities where is_primary group by project_id)
    select c.ticker, coalesce(nullif(g.line, ''), concat_ws(' · ', metal, nullif(project_name, ''), coalesce(state, country)), '') as meta_line from companies c left join given g on g.ticker = c.ticker left join first f on f.company_id = c.company_id left join prim p on p.project_id = f.project_id""")
def company_meta(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    meta = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("T"), k.cast("string")).alias("ticker"), F.when(k % 3 == 0, "").otherwise("gold").alias("commodity"), F.when(k % 2 == 0, F.col("s_name")).otherwise("").alias("flagship_project"), F.when((k % 6).isin(0, 3), "").otherwise("WA").alias("jurisdiction"))
    return company.company_meta(view(s, d, "companies"), meta, view(s, d, "projects"), view(s, d, "project_commodities"))


@query(f"""with {CAPITAL}, {SCORED}, ops as (select company_id, max(score) >= 0.4 as operations from scored group by company_id)
    select ticker, c.company_id in (select company_id from company_financials where doc_type in ('appendix_5b', 'quarterly_activity') and cash is not null) as financials, c.company_id in (select company_id from caps) as capital, coalesce(operations, false) as operations,
    c.company_id in (select company_id from projects where project_id in (select project_id from project_commodities where commodity in ('Au', 'Ag', 'Cu', 'Pd', 'Pt', 'U3O8'))) as comparison, ticker in (select ticker from filings) as documents from companies c left join ops o on o.company_id = c.company_id""")
def coverage_flags(s: SparkSession, d: str) -> DataFrame:
    return company.coverage_flags(view(s, d, "companies"), company.cash_history(view(s, d, "company_financials")), _caps(s, d), _scored(s, d), view(s, d, "project_commodities"), view(s, d, "filings"))


@query("select financial_id, companies.ticker as ticker, effective_date, f.review_reason, url from company_financials f join companies using (company_id) join filings d on d.document_id = f.document_id where needs_review order by financial_id desc limit 50")
def review_queue(s: SparkSession, d: str) -> DataFrame:
    return company.review_queue(view(s, d, "company_financials"), view(s, d, "companies"), view(s, d, "filings"))


@query("select (select count(*) from companies) as companies, (select count(*) from filings) as documents, (select count(*) from filings where parse_status = 'parsed') as docs_parsed, (select count(*) from filings where parse_status = 'pending') as docs_pending, (select count(*) from filings where parse_status = 'classified') as docs_classified, (select count(*) from filings where parse_status = 'failed') as docs_failed, (select count(*) from company_financials) as financials, (select count(*) from company_financials where needs_review) as needs_review")
def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    return company.corpus_stats(view(s, d, "companies"), view(s, d, "filings"), view(s, d, "company_financials"))


@query("select a as with_study_doc, b as with_parsed_study, a - b as recoverable_gap from (select count(distinct ticker) filter (where doc_type in ('study_dfs', 'study_pfs', 'study_scoping')) as a, count(distinct ticker) filter (where doc_type in ('study_dfs', 'study_pfs', 'study_scoping') and parse_status = 'parsed') as b from filings)")
def study_coverage(s: SparkSession, d: str) -> DataFrame:
    return company.study_coverage_gap(view(s, d, "filings"))


@query(f"select case when {TRANSIENT} then 'transient' else 'permanent' end as failure_class, count(*) as n from filings where parse_status = 'failed' group by 1")
def failures_by_class(s: SparkSession, d: str) -> DataFrame:
    return company.failures_by_class(view(s, d, "filings"))


@query("with own as (select * from filings where doc_type = 'resource_update') select 'status' as kind, parse_status as value, count(*) as n from own group by 2 union all select * from (select 'error', parse_error, count(*) from own where parse_error is not null group by 2 order by 3 desc, 2 limit 10) union all select * from (select 'recent', ticker, document_id from own order by announcement_date desc nulls last, document_id desc limit 20)")
def type_diagnosis(s: SparkSession, d: str) -> DataFrame:
    return company.type_diagnosis(view(s, d, "filings"), "resource_update")
