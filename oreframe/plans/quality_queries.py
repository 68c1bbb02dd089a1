"""Queries of checks and repairs, and of normalisation and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms as ff
from ..functions.text import npv_reasons as kept_reasons
from ..functions.valuation import tier_of
from ..operators import entities, forms, repairs
from .base import REVALUABLE, STAGE_RANK, TIER, day, now, query, rounded
from .bind import view
from .text_queries import CATEGORY, ITEMS, OLD, SECTIONS, SECURITIES, SNAPSHOT

FLAGGED = """with p as (select *, arg_max({'c': cash, 'b': burn, 's': shares_fd}, {'d': effective_date, 'i': financial_id}) over (partition by company_id order by financial_id rows between unbounded preceding and 1 preceding) as p from company_financials),
    f as (select *, doc_type in ('appendix_5b', 'quarterly_activity', 'presentation') as fc, doc_type in ('appendix_5b', 'quarterly_activity') as fb, doc_type in ('issue_of_securities', 'presentation') as fs from p)"""


@query(FLAGGED + """ select financial_id, concat_ws('; ', case when fs and shares_fd is null then 'missing_shares_fd' end, case when fc and cash is null then 'missing_cash' end, case when fb and burn is null then 'missing_opex_burn' end, case when fc and p.c <> 0 and abs(cash - p.c) / abs(p.c) > 0.5 then 'cash_50pct_deviation' end,
    case when fs and p.s <> 0 and abs(shares_fd - p.s) / abs(p.s) > 0.5 then 'shares_fd_50pct_deviation' end, case when fb and p.b <> 0 and abs(burn - p.b) / abs(p.b) > 0.5 then 'quarterly_opex_burn_50pct_deviation' end) as reason from f""")
def snapshot_review_flags(s: SparkSession, d: str) -> DataFrame:
    return repairs.review_flags(view(s, d, "company_financials")).select("financial_id", "reason")


@query("""select study_id, concat_ws('; ', case when pre_tax_npv is null then 'missing_pre_tax_npv' end, case when post_tax_npv is null then 'missing_post_tax_npv' end,
    case when pre_tax_npv <> 0 and post_tax_npv >= pre_tax_npv then 'post_tax_npv_ge_pre_tax_npv' when pre_tax_npv <> 0 and (1 - post_tax_npv / pre_tax_npv < 0.2 or 1 - post_tax_npv / pre_tax_npv > 0.45) then 'implied_tax_gap_' || printf('%.1f', round_even((1 - post_tax_npv / pre_tax_npv) * 100, 1)) || 'pct_out_of_band' end,
    case when tax_rate_pct is null then 'missing_tax_rate' end, case when discount_rate_pct <= 0 then 'discount_rate_nonpositive' end, case when aisc < 0 then 'aisc_negative' end) as reason from studies""")
def study_review_flags(s: SparkSession, d: str) -> DataFrame:
    return repairs.study_flags(view(s, d, "studies")).select("study_id", "reason")


@query("""select study_id, concat_ws('; ', case when post_tax_npv = pre_tax_npv then 'npv_post_equals_pre_suspected_duplicate' when post_tax_npv > pre_tax_npv then 'npv_post_gt_pre' end, case when aisc is not null and cast(contains(aisc_unit, 'USD') as int) + cast(contains(aisc_unit, 'US$') as int) + cast(contains(aisc_unit, 'AUD') as int) + cast(contains(aisc_unit, 'A$') as int) + cast(contains(aisc_unit, 'CAD') as int) + cast(contains(aisc_unit, 'C$') as int) >= 2 then 'aisc_unit_malformed:' || aisc_unit end) as warning from studies""")
def study_sanity(s: SparkSession, d: str) -> DataFrame:
    return repairs.study_sanity(view(s, d, "studies")).select("study_id", "warning")


@query("""with st as (select study_id, case study_id % 4 when 0 then 'Au' when 1 then 'Pt' else 'Zn' end as primary_commodity, case study_id % 3 when 0 then 5000.0 else null end as annual_production from studies),
    l as (select study_id, commodity, arg_min(annual_production, leg) as p, true as found from study_commodities group by all)
    select st.study_id, case when st.study_id in (select study_id from study_commodities) and found is null then 'primary_commodity_missing_from_basket:' || primary_commodity when l.p <> st.annual_production then 'primary_production_mismatch' end as warning from st left join l on l.study_id = st.study_id and l.commodity = primary_commodity""")
def primary_leg_check(s: SparkSession, d: str) -> DataFrame:
    k = F.col("study_id")
    st = view(s, d, "studies").select("study_id", F.when(k % 4 == 0, "Au").when(k % 4 == 1, "Pt").otherwise("Zn").alias("primary_commodity"), F.when(k % 3 == 0, 5000.0).alias("annual_production"))
    return repairs.primary_leg_check(st, view(s, d, "study_commodities").withColumn("annual_production", F.col("annual_production")))


@query("select study_id, case when study_date <= date '2000-01-01' then study_date end as study_date from studies")
def future_date_discard(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "studies").select("study_id", repairs.discard_future_date(F.col("study_date"), day("2000-01-01")).alias("study_date"))


@query("select study_id, case when regexp_full_match(first_production, '\\d{4}-\\d{2}-\\d{2}') then cast(first_production as date) when regexp_full_match(first_production, '\\d{4}-\\d{2}') then cast(first_production || '-01' as date) when regexp_full_match(first_production, '\\d{4}') then cast(first_production || '-01-01' as date) end as date, case when not regexp_full_match(first_production, '\\d{4}(-\\d{2}){0,2}') then 'first_production_unparseable:' || first_production end as warning from studies")
def first_production(s: SparkSession, d: str) -> DataFrame:
    date, warning = repairs.first_production(F.col("first_production"))
    return view(s, d, "studies").select("study_id", date.alias("date"), warning.alias("warning"))


@query("select study_id from studies where coalesce(post_tax_npv, pre_tax_npv) is not null and initial_capex is not null")
def minimum_data(s: SparkSession, d: str) -> DataFrame:
    return repairs.minimum_data(view(s, d, "studies")).select("study_id")


@query("""with st as (select study_id, study_date, case study_id % 3 when 0 then announcement_date - 10 when 1 then announcement_date end as said from studies)
    select study_id, least(study_date, said) as date, case when study_date > said then 'effective_date_after_announcement_clamped' when study_date is null and said is not null then 'study_date_from_announcement_date' end as warning from st""")
def study_date_clamp(s: SparkSession, d: str) -> DataFrame:
    k = F.col("study_id") % 3
    st = view(s, d, "studies").withColumn("announcement_date", F.when(k == 0, F.date_sub("announcement_date", 10)).when(k == 1, F.col("announcement_date")))
    return repairs.clamp_study_date(st).select("study_id", "date", "warning")


NAMES = "select doc_id, case doc_id % 8 when 0 then 'Granite Hill' when 1 then 'the Lease' when 2 then 'Updated' when 3 then 'Table 4 and the 2018 Annual' when 4 then 'Further information' when 5 then 'Hill confirms the lens' when 6 then substr(text, 1, 45) else '' end as name from documents"
PROSE = "(length(name) > 40 or len(string_split_regex(trim(name), '\\s+')) > 5 or regexp_matches(name, '^[a-z]') or regexp_matches(lower(trim(name)), '^(the|its|it|all|this|that|both|o|details|relates|release|continues|strike|additional|last|upper|further)(\\s|$)') or regexp_matches(lower(name), '(^|\\s)(has|was|were|will|expected|confirms|demonstrates|intended|completed|announced|updated|delivers|supports|used|show|unlock|emerge)(\\s|$)'))"
STARTS = "the|a|an|and|or|for|its|our|their|this|that|these|those|both|each|all|it|further|updated|revised|resumption|details|reporting|continues|later|regarding|information|following|additional"
FRAGMENT = "(trim({0}) = '' or regexp_matches(trim({0}), '^[a-z]') or (regexp_matches(lower(trim({0})), '^[.,:;]*(" + STARTS + ")[.,:;]*(\\s|$)') and len(string_split_regex(trim({0}), '\\s+')) <> 2) or regexp_matches(trim({0}), '\\s[.,:;]*(the|a|an|and|or|of|at|to|in|for|as|with|by|on|from|that|this|its|our|their|it)[.,:;]*(\\s|$)'))"


@query(f"select doc_id, {PROSE} as prose, {FRAGMENT.format('name')} as fragment, length(name) > 40 or regexp_matches(name, '^[a-z]') or regexp_matches(lower(name), '^(the|its|it|all|this|that|both|o|details|relates|release|continues|strike|additional|last|upper|further) ') as screen from ({NAMES})")
def junk_names(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 8
    name = F.when(k == 0, "Granite Hill").when(k == 1, "the Lease").when(k == 2, "Updated").when(k == 3, "Table 4 and the 2018 Annual").when(k == 4, "Further information").when(k == 5, "Hill confirms the lens").when(k == 6, F.substring("text", 1, 45)).otherwise("")
    return s.read.parquet(f"{d}/documents.parquet").withColumn("name", name).select("doc_id", *[c.alias(n) for n, c in repairs.name_rules(F.col("name")).items()])


@query(f"select study_id, coalesce(case header_tier when 'definitive' then 0 when 'indicative' then 1 when 'conceptual' then 2 end > case {TIER} when 'definitive' then 0 when 'indicative' then 1 else 2 end, false) as mismatch from studies")
def header_mismatch(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "studies").select("study_id", repairs.header_mismatch(F.col("header_tier"), tier_of(F.col("study_stage"))).alias("mismatch"))


EXPECTED = "case when grade_unit = 'g/t' and lower(unit) in ('moz', 'koz', 'oz') then tonnes * 1e6 * grade / 31.1035 / case lower(unit) when 'moz' then 1e6 when 'koz' then 1e3 else 1 end when grade_unit = '%' and lower(unit) in ('mt', 'kt', 't', 'mlb', 'klb') then tonnes * 1e6 * grade / 100 / case lower(unit) when 'mt' then 1e6 when 'kt' then 1e3 when 't' then 1 when 'mlb' then 1e6 / 2204.62262 else 1e3 / 2204.62262 end end"
LOW = "case commodity when 'Au' then 0.1 when 'Cu' then 0.05 when 'U3O8' then 50.0 when 'Ni' then 0.1 end"
HIGH = "case commodity when 'Au' then 100.0 when 'Cu' then 30.0 when 'U3O8' then 50000.0 when 'Ni' then 10.0 end"


def _estimates(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "estimate_rows").withColumn("category", ff.category(F.col("label")))


@query(f"""with c as (select *, {CATEGORY} as category, {EXPECTED} as expected from estimate_rows), e as (select document_id, count(*) filter (where category = 'Total') as totals, max(tonnes) filter (where category = 'Total') as total, sum(tonnes) filter (where category in ('Measured', 'Indicated', 'Inferred', 'Proven', 'Probable')) as parts,
        string_agg('grade_outlier_' || category, '; ' order by row_no) filter (where category <> 'Total' and (grade < {LOW} or grade > {HIGH})) as outliers, string_agg('contained_metal_mismatch_' || category, '; ' order by row_no) filter (where expected <> 0 and not contained / expected between 0.9 and 1.1) as off from c group by document_id)
    select document_id, concat_ws('; ', case when totals > 1 then 'multiple_total_rows_tonnes_check_skipped' when parts > 0 and abs(total - parts) / parts > 0.05 then 'total_tonnes_deviation_' || printf('%.1f', round_even(abs(total - parts) / parts * 100, 1)) || '%' end, outliers, off) as warnings from e""")
def estimate_validation(s: SparkSession, d: str) -> DataFrame:
    return repairs.validate_estimates(_estimates(s, d)).select("document_id", F.array_join("warnings", "; ").alias("warnings"))


@query(f"select document_id, row_no, round({EXPECTED}, 6) as expected from estimate_rows")
def expected_contained(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "estimate_rows").select("document_id", "row_no", rounded(ff.expected_contained(F.col("tonnes"), F.col("grade"), F.col("grade_unit"), F.col("unit")), 6).alias("expected"))


@query("""select financial_id, nullif(array_to_string(list_filter(list_filter(list_transform(string_split(review_reason, ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: not list_contains(case doc_type when 'appendix_5b' then ['missing_shares_fd'] when 'quarterly_activity' then ['missing_shares_fd'] when 'issue_of_securities' then ['missing_cash', 'missing_opex_burn'] when 'presentation' then ['missing_opex_burn'] else [] end, x)), '; '), '') as reason from company_financials""")
def clean_reasons(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "company_financials").select("financial_id", repairs.clean_reasons(F.col("review_reason"), F.col("doc_type")).alias("reason"))


@query("select financial_id, array_to_string(list_filter(list_transform(string_split(coalesce(review_reason, ''), ';'), lambda x: trim(x)), lambda x: contains(x, 'npv_ge_pre') or contains(x, 'implied_tax_gap') or contains(x, 'npv_post')), '; ') as kept from company_financials")
def npv_reasons(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "company_financials").select("financial_id", kept_reasons(F.col("review_reason")).alias("kept"))


@query("select financial_id from company_financials where strftime(effective_date, '%m-%d') not in ('03-31', '06-30', '09-30', '12-31')")
def bad_quarter_ends(s: SparkSession, d: str) -> DataFrame:
    return repairs.bad_quarter_ends(view(s, d, "company_financials"))[1].select("financial_id")


@query(f"select revaluation_id from revals where study_confidence_tier is not null and study_confidence_tier <> 'conceptual' and study_id not in (select study_id from studies where study_confidence_tier = 'conceptual')")
def repair_revals(s: SparkSession, d: str) -> DataFrame:
    return repairs.repair_studies_and_revals(view(s, d, "studies"), view(s, d, "revals"), day("2000-01-01"))[1].select("revaluation_id")


TWICE = "select study_id, leg, commodity, leg in (1, 2) and study_id % 5 = 0 or leg = 1 as is_primary from study_commodities"


@query(f"with t as ({TWICE}) select study_id, leg from t where study_id not in (select study_id from t where is_primary group by study_id having count(*) >= 2)")
def fabricated_legs(s: SparkSession, d: str) -> DataFrame:
    legs = view(s, d, "study_commodities").withColumn("is_primary", (F.col("leg").isin(1, 2) & (F.col("study_id") % 5 == 0)) | (F.col("leg") == 1))
    return repairs.fabricated_legs(legs)[1].select("study_id", "leg")


@query("select study_id, leg, case when commodity in ('Pd', 'Pt') and study_id % 2 = 0 then 'oz' when study_id % 2 = 0 then 't' else 'lb' end as unit from study_commodities")
def relabel_units(s: SparkSession, d: str) -> DataFrame:
    unit = F.when(F.col("study_id") % 2 == 0, "t").otherwise("lb")
    return view(s, d, "study_commodities").select("study_id", "leg", repairs.relabel_units(F.col("commodity"), unit).alias("unit"))


@query("""select financial_id, case financial_id % 5 when 0 then 1.0 else cash end as cash, case financial_id % 5 when 1 then null else burn end as burn, needs_review and financial_id % 5 > 1 as needs_review, case when financial_id % 5 < 2 then timestamp '2024-01-29 12:00:00' end as reviewed_at from company_financials""")
def apply_overrides(s: SparkSession, d: str) -> DataFrame:
    f, k = view(s, d, "company_financials"), F.col("financial_id") % 5
    given = F.when(k == 0, F.create_map(F.lit("cash"), F.lit(1.0))).when(k == 1, F.create_map(F.lit("burn"), F.lit(None).cast("double")))
    out = repairs.apply_overrides(f, f.select("financial_id", given.alias("given")).where("given is not null"), ("cash", "burn"), now())
    return out.select("financial_id", "cash", "burn", "needs_review", "reviewed_at")


@query("select document_id, case when lower(trim(x)) not in ('null', 'none', 'n/a') then x end as x, nullif(y, 'None') as y from (select document_id, case document_id % 6 when 0 then 'null' when 1 then ' None ' when 2 then 'N/A' when 3 then '' else ticker end as x, case document_id % 2 when 0 then 'None' else 'kept' end as y from filings)")
def string_nulls(s: SparkSession, d: str) -> DataFrame:
    k = F.col("document_id")
    x = F.when(k % 6 == 0, "null").when(k % 6 == 1, " None ").when(k % 6 == 2, "N/A").when(k % 6 == 3, "").otherwise(F.col("ticker"))
    return repairs.string_nulls(view(s, d, "filings").select("document_id", x.alias("x"), F.when(k % 2 == 0, "None").otherwise("kept").alias("y")))


@query(f"with {SECTIONS}, {ITEMS} select i.document_id, ticker, effective_date, coalesce(announcement_date, effective_date) as announcement_date, cash * 1000 as cash, debt * 1000 as debt, operating * -1000 as burn, receipts * 1000 as receipts from items i join filings f on f.document_id = i.document_id where effective_date is not null")
def fin_from_cashflow(s: SparkSession, d: str) -> DataFrame:
    section = forms.cashflow_section(view(s, d, "filing_pages"))
    items = forms.finalize_cashflow(section.select("document_id", *[c.alias(n) for n, c in forms.cashflow_items(F.col("section")).items()]))
    staged = items.withColumn("raw_json", F.to_json(F.struct("receipts_from_customers", "quarterly_financing")))
    return entities.financials_from_cashflow(staged, view(s, d, "filings"))[0].select("document_id", "ticker", "effective_date", "announcement_date", "cash", "debt", "burn", "receipts")


@query(f"""with {OLD}, t as (select document_id, sum(case when cdi and a is not null then n * b / a else n end) filter (where kind = 'ordinary') as sh, sum(n) filter (where kind = 'option') as op, sum(n) filter (where kind = 'performance_right') as ri from oldkinds where kind is not null group by document_id),
    dated as (select document_id, cast(try_strptime(nullif(regexp_extract(text, '(?i)(?:issue\\s+date|date\\s+.*?issued)\\s*\\n?\\s*(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), ''), '%d/%m/%Y') as date) as issued from filing_pages where page_no = 1)
    select t.document_id, ticker, coalesce(issued, announcement_date) as effective_date, coalesce(announcement_date, issued) as announcement_date, sh as shares_basic, sh + coalesce(op, 0) + coalesce(ri, 0) as shares_fd from t join filings f on f.document_id = t.document_id left join dated d on d.document_id = t.document_id""")
def fin_from_securities(s: SparkSession, d: str) -> DataFrame:
    pages = view(s, d, "filing_pages")
    issued = pages.where("page_no = 1").select("document_id", forms.issue_details(F.col("text"))["issue_date"].alias("effective_date"))
    staged = forms.security_totals(pages).join(issued, "document_id", "left")
    return entities.financials_from_securities(staged, view(s, d, "filings")).select("document_id", "ticker", "effective_date", "announcement_date", "shares_basic", "shares_fd")


@query(f"""with {SNAPSHOT} select s.document_id, ticker, coalesce(effective_date, announcement_date) as effective_date, coalesce(announcement_date, effective_date) as announcement_date, cash, debt, shares_basic, coalesce(shares_fd, shares_basic + coalesce(options_outstanding, 0) + coalesce(perf_rights_outstanding, 0)) as shares_fd
    from snap s join filings f on f.document_id = s.document_id where coalesce(shares_basic, 0) <> 0 or coalesce(shares_fd, 0) <> 0 or coalesce(cash, 0) <> 0""")
def fin_from_presentation(s: SparkSession, d: str) -> DataFrame:
    return entities.financials_from_presentation(forms.snapshot_fields(view(s, d, "filing_pages")), view(s, d, "filings")).select("document_id", "ticker", "effective_date", "announcement_date", "cash", "debt", "shares_basic", "shares_fd")


def _capital(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = forms.security_rows(forms.capital_section(view(s, d, "filing_pages")))
    return entities.financials_from_capital(forms.capital_totals(rows), rows, view(s, d, "filings"))


@query(f"""with {SECURITIES}, b as (select document_id, sum(total_on_issue) filter (where kind = 'share') as basic, sum(total_on_issue) as fd, coalesce(sum(total_on_issue) filter (where kind = 'option'), 0) as options from securities group by document_id)
    select b.document_id, ticker, announcement_date as effective_date, cast(basic as double) as shares_basic, cast(fd as double) as shares_fd, cast(options as double) as options_outstanding from b join filings f on f.document_id = b.document_id where basic > 0""")
def fin_from_capital(s: SparkSession, d: str) -> DataFrame:
    return _capital(s, d)[0].select("document_id", "ticker", "effective_date", "shares_basic", "shares_fd", "options_outstanding")


@query(f"with {SECURITIES} select document_id, code, kind as instrument_type, total_on_issue, expiry_date from securities where kind <> 'share' and document_id in (select document_id from securities where kind = 'share' group by document_id having sum(total_on_issue) > 0)")
def unquoted_instruments(s: SparkSession, d: str) -> DataFrame:
    return _capital(s, d)[2].select("document_id", "code", "instrument_type", "total_on_issue", "expiry_date")


W1 = "string_split_regex(trim(coalesce(company_name, '')), '\\s+')[1]"
STRIPPED = f"case when length({W1}) >= 3 and regexp_replace(project_name, '(?i)^' || regexp_escape({W1}) || '\\s+', '') <> '' then regexp_replace(project_name, '(?i)^' || regexp_escape({W1}) || '\\s+', '') else project_name end"
SYM = "(?:PGE|Ni|Cu|Co|Au|Ag|Zn|Pb|Li|Sn|U|REE|Fe)"
TAIL = "(?i)\\s+(?:Project|Deposit|Mine|Operations?|Limited|Ltd|Gold|Copper|Lithium|Nickel|Silver|Zinc|Uranium|Cobalt|Graphite|Iron\\s*Ore|Iron|Rare\\s*Earths?)\\s*$"
CHAINED = f"coalesce(nullif(trim(regexp_replace({STRIPPED}, '(?i)\\s+{SYM}(?:\\s*[-–/]\\s*{SYM})+\\s*$', '')), ''), {STRIPPED})"
CANON = CHAINED
for _ in range(3):
    CANON = f"trim(regexp_replace({CANON}, '{TAIL}', ''))"
CANON = f"coalesce(nullif({CANON}, ''), trim(project_name))"


@query(f"select project_id, {CANON} as canonical from forks")
def canonical_name(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "forks").select("project_id", entities.canonical_name(F.col("project_name"), F.col("company_name")).alias("canonical"))


MENTIONS = "select study_id as mention_id, company_id, case company_id % 4 when 0 then 'Vulcan Energy Limited' when 1 then 'Ra Ltd' when 2 then null else 'Paris Gold NL' end as company_name, case study_id % 6 when 0 then 'Granite Hill Project' when 1 then 'Vulcan Paris' when 2 then 'Further information regarding the' when 3 then 'New Lode Copper Mine' when 4 then 'new lode' else 'Paris Ni-Cu' end as project_name from studies"


@query(f"""with m as ({MENTIONS}), mc as (select *, {CANON} as canonical from m), fc as (select *, lower({CANON}) as k from forks), have as (select company_id, k, arg_max(project_id, (created_at, project_id)) as matched from fc group by all), reals as (select company_id, arg_max(project_id, (created_at, project_id)) as fallback from forks where not {FRAGMENT.format('project_name')} group by all)
    select mention_id, m.company_id, coalesce(matched, case when {FRAGMENT.format('canonical')} then fallback end) as project_id, canonical, case when matched is not null then 'matched' when {FRAGMENT.format('canonical')} and fallback is not null then 'attached' else 'created' end as outcome
    from mc m left join have h on h.company_id = m.company_id and h.k = lower(canonical) left join reals r on r.company_id = m.company_id""")
def resolve_projects(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("study_id") % 6, F.col("company_id") % 4
    name = F.when(k == 0, "Granite Hill Project").when(k == 1, "Vulcan Paris").when(k == 2, "Further information regarding the").when(k == 3, "New Lode Copper Mine").when(k == 4, "new lode").otherwise("Paris Ni-Cu")
    company = F.when(c == 0, "Vulcan Energy Limited").when(c == 1, "Ra Ltd").when(c == 3, "Paris Gold NL")
    mentions = view(s, d, "studies").select(F.col("study_id").alias("mention_id"), "company_id", company.alias("company_name"), name.alias("project_name"))
    return entities.resolve_projects(mentions, view(s, d, "forks"))


CROSS = f"crossed as (select project_id, company_id, project_name, {CANON} as canonical, min(project_id) over (partition by company_id, lower({CANON})) as keeper, count(*) over (partition by company_id, lower({CANON})) as size from forks), shared as (select study_id, project_id, case when study_id % 7 > 0 then study_stage end as study_stage, case study_id % 4 when 0 then null else study_id % 3 end as npv from studies)"
MOVED = f"{CROSS}, moved as (select study_id, study_stage, npv, coalesce(keeper, s.project_id) as project_id, coalesce(s.project_id = keeper, true) as own from shared s left join crossed c on c.project_id = s.project_id), ranked as (select *, row_number() over (partition by project_id, study_stage, npv order by own desc, study_id) as r from moved)"


def _merged(s: SparkSession, d: str) -> dict[str, DataFrame]:
    k = F.col("study_id")
    studies = view(s, d, "studies").select("study_id", "project_id", F.when(k % 7 > 0, F.col("study_stage")).alias("study_stage"), F.when(k % 4 != 0, (k % 3).cast("double")).alias("post_tax_npv"))
    return entities.merge_forks(view(s, d, "forks"), studies, view(s, d, "revals"), view(s, d, "resources"), view(s, d, "project_commodities"), view(s, d, "stage_inferences"))


@query(f"with {MOVED} select study_id, project_id from ranked where own or study_stage is null or r = 1")
def merge_forks(s: SparkSession, d: str) -> DataFrame:
    return _merged(s, d)["studies"].select("study_id", "project_id")


@query(f"with {CROSS} select project_id, case when size > 1 then canonical else project_name end as project_name from crossed where project_id = keeper")
def merge_forks_projects(s: SparkSession, d: str) -> DataFrame:
    return _merged(s, d)["projects"].select("project_id", "project_name")


@query(f"with {MOVED} select revaluation_id, coalesce(keeper, r.project_id) as project_id from revals r left join crossed c on c.project_id = r.project_id where study_id not in (select study_id from ranked where not (own or study_stage is null or r = 1))")
def merge_forks_revaluations(s: SparkSession, d: str) -> DataFrame:
    return _merged(s, d)["revaluations"].select("revaluation_id", "project_id")


@query(f"with {CROSS} select inference_id, coalesce(keeper, i.project_id) as project_id, inferred_stage from stage_inferences i left join crossed c on c.project_id = i.project_id")
def merge_forks_inferences(s: SparkSession, d: str) -> DataFrame:
    return _merged(s, d)["inferences"].select("inference_id", "project_id", "inferred_stage")


@query(f"""with {MOVED}, gone as (select study_id from ranked where not (own or study_stage is null or r = 1))
    select count(*) filter (where project_id = keeper and size > 1) as groups_merged, count(*) filter (where project_id <> keeper) as projects_removed, (select count(*) from ranked where not own and (study_stage is null or r = 1)) as studies_repointed,
        (select count(*) from gone) as dup_studies_deleted, (select count(*) from revals where study_id in (select study_id from gone)) as revals_deleted from crossed""")
def merge_forks_stats(s: SparkSession, d: str) -> DataFrame:
    return _merged(s, d)["stats"]


@query(f"with {CROSS} select coalesce(keeper, p.project_id) as project_id, commodity, arg_max(is_primary, (p.project_id = keeper, -p.project_id)) as is_primary from project_commodities p left join crossed c on c.project_id = p.project_id group by 1, 2")
def merge_forks_commodities(s: SparkSession, d: str) -> DataFrame:
    return _merged(s, d)["commodities"]


NORM = "{0} * case {1} when 'koz/yr' then 1000 when 'Moz pa' then 1000000 when 'ktpa contained' then 1000 when 'Mlb' then 1000000 when 'kt' then 1000 else 1 end"


@query(f"""with st as (select study_id, case study_id % 5 when 0 then 'null' when 1 then 'Cu' else 'Au' end as pc, {NORM.format('annual_production', 'annual_production_unit')} as own, study_id % 3 as k from studies), listed as (select study_id, 0 as leg, 'Au' as commodity, pc, own, 5.0 * 1000 as norm from st where k = 0 union all select study_id, 2, 'Cu', pc, own, null from st where k = 0),
    legs as (select study_id, leg - case when leg = 2 then 1 else 0 end as leg, commodity, case when commodity = pc then own else norm end as annual_production, commodity = pc as is_primary from listed union all select study_id, 0, pc, own, true from st where k <> 0 and pc <> 'null')
    select study_id, leg, commodity, round(annual_production, 3) as annual_production, is_primary, case commodity when 'Au' then 'oz' else 't' end as unit from legs""")
def study_legs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("study_id")
    basket = F.when(k % 3 == 0, F.from_json(F.lit('[{"commodity":"Au","annual_production":5.0,"unit":"kt"},{"commodity":"None"},{"commodity":"Cu"}]'), "array<struct<commodity:string,annual_production:double,unit:string>>"))
    st = view(s, d, "studies").select("study_id", F.when(k % 5 == 0, "null").when(k % 5 == 1, "Cu").otherwise("Au").alias("primary_commodity"), "annual_production", "annual_production_unit", basket.alias("basket"))
    return entities.study_legs(st).withColumn("annual_production", rounded("annual_production", 3))


@query("with one as (select project_id, min(commodity) as commodity from project_commodities where is_primary group by project_id having count(*) = 1) select study_id, commodity, annual_production, true as is_primary from studies join one using (project_id) where study_id not in (select study_id from study_commodities where leg > 1)")
def backfill_legs(s: SparkSession, d: str) -> DataFrame:
    return entities.backfill_legs(view(s, d, "studies"), view(s, d, "project_commodities"), view(s, d, "study_commodities").where("leg > 1"))


@query("""with e as (select project_id, study_stage, post_tax_npv from studies where study_confidence = 'old'), i as (select *, row_number() over (partition by project_id, study_stage, npv order by study_id) as r from (select study_id, project_id, case when study_id % 9 > 0 then study_stage end as study_stage, case when study_id % 2 = 0 then post_tax_npv else study_id % 4 end as npv from studies))
    select study_id from i where (r = 1 or study_stage is null) and not exists (select 1 from studies x where x.project_id = i.project_id and x.study_stage = i.study_stage and x.post_tax_npv is not distinct from i.npv)""".replace("e as (select project_id, study_stage, post_tax_npv from studies where study_confidence = 'old'), ", ""))
def dedup_studies(s: SparkSession, d: str) -> DataFrame:
    k = F.col("study_id")
    st = view(s, d, "studies").select("study_id", "project_id", "study_stage", "post_tax_npv")
    return entities.dedup_studies(st, st.withColumn("study_stage", F.when(k % 9 > 0, F.col("study_stage"))).withColumn("post_tax_npv", F.when(k % 2 == 0, F.col("post_tax_npv")).otherwise((k % 4).cast("double")))).select("study_id")


DEPOSITS = "select p_partkey, case p_partkey % 9 when 0 then ' ' else 'Mine ' || p_partkey end as deposit_name, case p_partkey % 5 when 0 then '' when 1 then 'Op  ' || p_partkey % 50 || ' LIMITED' when 2 then ' Op ' || p_partkey % 50 || ' n.l.' else 'Op ' || p_partkey % 70 || ' Pty' end as operator_name, case p_partkey % 4 when 0 then 'Operating Mine' when 1 then ' prospect ' when 2 then 'PFS' else 'closed' end as operating_status, case p_partkey % 3 when 0 then 'Au; Cu/Ag' when 1 then ' Ni ' else ',' end as commodities from part"


def _deposits(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    op = lambda n: (k % n).cast("string")
    return s.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("Mine "), k.cast("string"))).alias("deposit_name"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("Op  "), op(50), F.lit(" LIMITED"))).when(k % 5 == 2, F.concat(F.lit(" Op "), op(50), F.lit(" n.l."))).otherwise(F.concat(F.lit("Op "), op(70), F.lit(" Pty"))).alias("operator_name"),
        F.when(k % 4 == 0, "Operating Mine").when(k % 4 == 1, " prospect ").when(k % 4 == 2, "PFS").otherwise("closed").alias("operating_status"), F.when(k % 3 == 0, "Au; Cu/Ag").when(k % 3 == 1, " Ni ").otherwise(",").alias("commodities"),
    )


OPERATORS = "mapping as (select 'op ' || s_suppkey as operator, case s_suppkey % 6 when 0 then 'NONE' else 'T' || s_suppkey end as ticker from supplier)"
MATCHED = f"{OPERATORS}, dep as ({DEPOSITS}), keyed as (select *, regexp_replace(trim(regexp_replace(lower(trim(operator_name)), '\\s+(?:limited|ltd\\.?|pty|plc|corp|corporation|inc|n\\.?l\\.?)\\s*$', '')), '\\s+', ' ', 'g') as operator from dep), matchd as (select k.*, m.ticker, c.company_id, case when trim(deposit_name) = '' or trim(operator_name) = '' or m.ticker is null then 'skipped_unmapped' when c.company_id is null then 'skipped_no_company' else 'matched' end as outcome from keyed k left join mapping m on m.operator = k.operator left join companies c on c.ticker = m.ticker)"


def _matched(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    mapping = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("op "), k.cast("string")).alias("operator"), F.when(k % 6 == 0, "NONE").otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("ticker"))
    return entities.match_operators(_deposits(s, d), mapping, view(s, d, "companies"))


@query(f"with {MATCHED} select p_partkey, operator, ticker, outcome from matchd")
def operator_match(s: SparkSession, d: str) -> DataFrame:
    return _matched(s, d).select("p_partkey", "operator", "ticker", "outcome")


@query(f"select p_partkey, case lower(trim(operating_status)) when 'operating mine' then 'production' when 'prospect' then 'exploration' when 'pfs' then 'feasibility' end as stage from ({DEPOSITS})")
def stage_norm(s: SparkSession, d: str) -> DataFrame:
    return _deposits(s, d).select("p_partkey", entities.normalize_stage(F.col("operating_status")).alias("stage"))


@query("select p_partkey, 0 as place, case p_partkey % 3 when 0 then 'Au' else 'Ni' end as metal, true as is_primary from part where p_partkey % 3 < 2 union all select p_partkey, 1, 'Cu', false from part where p_partkey % 3 = 0 union all select p_partkey, 2, 'Ag', false from part where p_partkey % 3 = 0")
def split_commodities(s: SparkSession, d: str) -> DataFrame:
    return entities.split_commodities(_deposits(s, d), "commodities").select("p_partkey", "place", "metal", "is_primary")


INCOMING = "inc as (select company_id, lower(project_name) as name, max('Australia') as country, max(case when project_id % 2 = 0 then 'SA' end) as state from projects where project_id % 10 < 4 group by all union all select c_custkey, 'new prospect', 'Australia', null from customer)"
HAVE = "have as (select company_id, lower(project_name) as name, max(country) as country, max(state) as state from projects group by all)"
UPSERTED = f"{HAVE}, {INCOMING}, ups as (select coalesce(h.company_id, i.company_id) as company_id, coalesce(h.name, i.name) as name, coalesce(h.country, i.country) as country, coalesce(h.state, i.state) as state, case when h.company_id is null then 'inserted' when i.company_id is not null and ((h.country is null and i.country is not null) or (h.state is null and i.state is not null)) then 'updated' else 'unchanged' end as outcome from have h full join inc i on i.company_id = h.company_id and i.name = h.name)"


def _upserted(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "projects").withColumn("name", F.lower("project_name"))
    have = p.groupBy("company_id", "name").agg(F.max("country").alias("country"), F.max("state").alias("state"))
    inc = p.where("project_id % 10 < 4").groupBy("company_id", "name").agg(F.lit("Australia").alias("country"), F.max(F.when(F.col("project_id") % 2 == 0, "SA")).alias("state"))
    new = view(s, d, "companies").select("company_id", F.lit("new prospect").alias("name"), F.lit("Australia").alias("country"), F.lit(None).cast("string").alias("state"))
    return entities.fill_null_upsert(have, inc.unionByName(new), ["company_id", "name"], ["country", "state"])


@query(f"with {UPSERTED} select * from ups")
def fill_null_upsert(s: SparkSession, d: str) -> DataFrame:
    return _upserted(s, d)


@query(f"with {MATCHED}, {UPSERTED} select (select count(*) from matchd) as fetched, (select count(*) from matchd where outcome = 'matched') as matched, (select count(*) from matchd where outcome = 'skipped_unmapped') as skipped_unmapped, (select count(*) from matchd where outcome = 'skipped_no_company') as skipped_no_company, (select count(*) from ups where outcome = 'inserted') as inserted, (select count(*) from ups where outcome = 'updated') as updated")
def load_stats(s: SparkSession, d: str) -> DataFrame:
    return entities.load_stats(_matched(s, d), _upserted(s, d))


@query(f"select project_id, e.document_id, announcement_date as effective_date, commodity, {CATEGORY} as category, tonnes, grade, grade_unit, contained as contained_metal, unit as contained_metal_unit from estimate_rows e join filings f on f.document_id = e.document_id where {CATEGORY} <> 'Total'")
def resources_load(s: SparkSession, d: str) -> DataFrame:
    rows = _estimates(s, d).where("category is not null").join(view(s, d, "filings").select("document_id", F.col("announcement_date").alias("effective_date")), "document_id")
    return entities.resources_from_estimates(rows, keep_totals=False)


@query("select project_id, p.ticker, newest from (select project_id, ticker, case project_id % 3 when 0 then null else project_id % 250 end as mark from projects join companies using (company_id)) p join (select ticker, max(document_id) as newest from filings group by ticker) n on n.ticker = p.ticker where newest > coalesce(mark, 0)")
def stage_worklist(s: SparkSession, d: str) -> DataFrame:
    p = view(s, d, "projects").withColumn("last_classified_doc_id", F.when(F.col("project_id") % 3 != 0, F.col("project_id") % 250))
    return entities.stage_worklist(p, view(s, d, "companies"), view(s, d, "filings"))


@query("""with p as (select project_id, company_id, project_name, ticker from projects join companies using (company_id)), recent as (select * from filings where announcement_date between date '2001-07-01' - 180 and date '2001-07-01'),
    st as (select project_id, list(study_id order by r) as ids from (select *, row_number() over (partition by project_id order by coalesce(study_date, announcement_date) desc nulls last, study_id desc) as r from studies) where r <= 3 group by project_id),
    rs as (select project_id, list(resource_id order by r) as ids from (select *, row_number() over (partition by project_id order by effective_date desc nulls last, resource_id desc) as r from resources) where r <= 3 group by project_id),
    named as (select project_id, list(document_id order by r) as ids from (select project_id, document_id, row_number() over (partition by project_id order by announcement_date desc, document_id desc) as r from p join recent f on f.ticker = p.ticker where contains(lower(header), lower(project_name))) where r <= 6 group by project_id),
    anys as (select ticker, list(document_id order by r) as ids from (select ticker, document_id, row_number() over (partition by ticker order by announcement_date desc, document_id desc) as r from recent where announcement_date >= date '2001-07-01' - 90) where r <= 6 group by ticker)
    select p.project_id, array_to_string(st.ids, ',') as studies, array_to_string(rs.ids, ',') as resources, array_to_string(coalesce(n.ids, a.ids), ',') as announcements from p left join st on st.project_id = p.project_id left join rs on rs.project_id = p.project_id left join named n on n.project_id = p.project_id left join anys a on a.ticker = p.ticker""")
def stage_evidence(s: SparkSession, d: str) -> DataFrame:
    out = entities.stage_evidence(view(s, d, "projects"), view(s, d, "companies"), view(s, d, "studies"), view(s, d, "resources"), view(s, d, "filings"), day("2001-07-01"))
    ids = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",").alias(c)
    return out.select("project_id", ids("studies", "study_id"), ids("resources", "resource_id"), ids("announcements", "document_id"))


@query(f"select project_id, min(case study_confidence_tier when 'definitive' then 0 when 'indicative' then 1 when 'conceptual' then 2 end) as best from studies group by project_id")
def best_tier(s: SparkSession, d: str) -> DataFrame:
    return entities.best_tier(view(s, d, "studies").withColumn("tier", F.col("study_confidence_tier")))


@query(f"""with lr as (select company_id, receipts from (select *, row_number() over (partition by company_id order by effective_date desc, financial_id desc) as r from company_financials where receipts is not null) where r = 1), sells as (select company_id from lr where receipts between 1000000 and 5000000000),
    best as (select project_id from (select *, row_number() over (partition by company_id order by {STAGE_RANK}, project_id) as r from projects) where r = 1 and company_id in (select company_id from sells)), rv as (select distinct project_id from studies where {REVALUABLE}),
    m as (select project_id, stage, (coalesce(production_start_date <= date '1998-01-01', false) and project_id in (select project_id from rv)) or project_id in (select project_id from best) as produces from projects)
    select project_id, stage, case when produces then 'production' else stage end as new_stage, produces and stage is distinct from 'production' as promoted from m""")
def production_floor(s: SparkSession, d: str) -> DataFrame:
    return entities.production_floor(view(s, d, "projects"), view(s, d, "company_financials"), view(s, d, "studies"), day("1998-01-01"))


@query("select 'stage' as kind, stage as value, count(*) as n from projects group by stage union all select 'confidence', case project_id % 3 when 0 then 'high' when 1 then 'low' end, count(*) from projects where project_id % 3 < 2 group by 2")
def stage_counts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("project_id") % 3
    return entities.stage_counts(view(s, d, "projects").select("stage", F.when(k == 0, "high").when(k == 1, "low").alias("confidence")))
