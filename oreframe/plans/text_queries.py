"""Queries of classification and extraction from page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import forms as f
from ..functions import text as t
from ..operators import forms
from .base import query, rounded
from .bind import view

HEADLINE = """case when regexp_matches(h, 'appendix 5b|quarterly cash ?flow') then 'appendix_5b'
    when regexp_matches(h, 'definitive feasibility|final feasibility study|ffs results|bankable feasibility study|bfs results|feasibility update|dfs') then 'study_dfs' when regexp_matches(h, 'pre-feasibility|pfs') then 'study_pfs'
    when regexp_matches(h, 'scoping study|preliminary economic assessment') then 'study_scoping'
    when regexp_matches(h, 'appendix 3g|appendix 3b|appendix 2a|notification of issue|issue, conversion or payment|conversion of securities|exercise of options|vesting of performance rights|application for quotation of securities|statement of cdis|cdis on issue|cessation of securities') then 'issue_of_securities'
    when regexp_matches(h, 'placement|entitlement offer|rights issue|capital raising|share purchase plan|spp') then 'placement' when regexp_matches(h, '(resource|reserve) estimate|jorc resource|mineral resource|ore reserve|resource update|maiden resource') then 'resource_update'
    when regexp_matches(h, 'half[ -]year|interim financial|6 month') then 'half_year_report' when regexp_matches(h, 'annual report|annual financial') then 'annual_report'
    when regexp_matches(h, 'quarterly (activity|report|activities|production|update)|operations update|quarter (update|report|financials)|(march|june|september|december|first|second|third|fourth) quarter|q[1234] |investment update') then 'quarterly_activity'
    when regexp_matches(h, 'presentation|investor update|corporate update') then 'presentation'
    when regexp_matches(regexp_replace(h, 'pre[- ]?feasibility\\s+study', '', 'g'), 'feasibility\\s+study') and not contains(h, 'scoping') then 'study_dfs' end"""
HEADED = "select document_id, regexp_replace(lower(header), '^\\s+|\\s+$', '', 'g') as h from filings"
FIRST_PAGE = """case when regexp_matches(lower(text), 'appendix 5b|mining exploration entity|quarterly cash flow report') then 'appendix_5b' when regexp_matches(lower(text), 'notification of issue|appendix 3g|securities issued or to be issued') then 'issue_of_securities'
    when regexp_matches(lower(text), 'annual report|directors'' report') then 'annual_report' when regexp_matches(lower(text), 'half year financial|interim financial report') then 'half_year_report' end"""
AMOUNT = "case when trim({0}) in ('', '-', '–', '—', 'N/A', 'n/a', 'nil', 'Nil') then null when regexp_matches(trim({0}), '^\\(.*\\)$') then -try_cast(replace(regexp_extract(trim({0}), '^\\((.*)\\)$', 1), ',', '') as double) else try_cast(replace(trim({0}), ',', '') as double) end"
FUNDING = "case when lower(trim({0})) in ('n/a', 'na', 'not applicable', 'nil') then null when starts_with(trim({0}), '>') then try_cast(regexp_extract(trim({0}), '^>\\s*(\\d+\\.?\\d*)', 1) as double) else try_cast(replace(trim({0}), ',', '') as double) end"


def q(pattern: str) -> str:
    """A pattern inside an SQL literal."""
    return pattern.replace("'", "''")


def pages(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "filing_pages")


@query(f"select document_id, {HEADLINE} as doc_type from ({HEADED})")
def headline_class(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "filings").select("document_id", t.headline_type(F.col("header")).alias("doc_type"))


@query(f"with headed as ({HEADED}), firsts as (select document_id, {FIRST_PAGE} as by_page from filing_pages where page_no = 1) select h.document_id, coalesce({HEADLINE}, by_page, 'other') as doc_type from headed h left join firsts f on f.document_id = h.document_id")
def document_class(s: SparkSession, d: str) -> DataFrame:
    return forms.classify_documents(view(s, d, "filings"), pages(s, d))


@query("""with k as (select document_id, page_no, lower(text) as x from filing_pages),
    m as (select document_id, page_no, case when regexp_matches(x, 'appendix 5b|quarterly cash flow report|mining exploration entity') and regexp_matches(x, '\\b1\\.\\s*cash\\s+flows\\s+from\\s+operating\\s+activities|\\b4\\.\\s*net\\s+(increase|decrease).*cash|\\b8\\.\\s*estimated\\s+cash\\s+available') then 'appendix_5b'
        when regexp_matches(x, 'appendix 3g|appendix 2a|notification of issue, conversion or payment|application for quotation of securities') then 'issue_of_securities' end as form from k)
    select document_id, arg_min(form, page_no) as form from m where form is not null group by document_id""")
def embedded_form(s: SparkSession, d: str) -> DataFrame:
    return forms.embedded_form(pages(s, d))


GATE_PARTS = """with l as (select document_id, page_no, lower(regexp_replace(text, '\\s+', ' ', 'g')) as x from filing_pages),
    m as (select document_id, bool_or(regexp_matches(x, 'asx\\s+listing\\s+rules\\s+appendix\\s*5b\\s*\\(\\d{2}/\\d{2}/\\d{2}\\)')) as footer, bool_or(page_no = 1 and regexp_matches(x, 'appendix\\s*5b|mining\\s+exploration\\s+entity\\s+or\\s+oil\\s+and\\s+gas\\s+exploration\\s+entity|rule\\s*5\\.5')) as first_page,
        bool_or(page_no > 1 and regexp_matches(x, 'appendix\\s*5b|mining\\s+exploration\\s+entity\\s+or\\s+oil\\s+and\\s+gas\\s+exploration\\s+entity|rule\\s*5\\.5')) as later,
        max(case when page_no = 1 then coalesce(nullif(regexp_extract(x, 'appendix\\s*4c'), ''), nullif(regexp_extract(x, 'appendix\\s*5a'), ''), nullif(regexp_extract(x, 'appendix\\s*4d'), ''), nullif(regexp_extract(x, 'appendix\\s*4e'), '')) end) as odd from l group by document_id)"""


@query(GATE_PARTS + " select document_id, case when footer then 'ok' when first_page and odd is not null then 'disqualifier:' || odd when first_page or later then 'ok' else 'no_5b_marker_on_any_page' end as reason from m")
def gate_form(s: SparkSession, d: str) -> DataFrame:
    return forms.cashflow_gate(pages(s, d))


@query("select document_id, case when announcement_date is null then 'missing_effective_date' when strftime(announcement_date, '%m-%d') in ('03-31', '06-30', '09-30', '12-31') then 'ok' else 'not_quarter_end:' || announcement_date end as reason from filings")
def gate_quarter_end(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "filings").select("document_id", forms.quarter_end_gate(F.col("announcement_date")).alias("reason"))


SECTIONS = """l as (select document_id, page_no, text, lower(text) as low, lower(regexp_replace(text, '\\s+', ' ', 'g')) as x from filing_pages),
    starts as (select document_id, coalesce(min(page_no) filter (where regexp_matches(x, 'asx\\s+listing\\s+rules\\s+appendix\\s*5b\\s*\\(\\d{2}/\\d{2}/\\d{2}\\)')),
        min(page_no) filter (where regexp_matches(x, 'appendix\\s*5b\\s*[–—-]\\s*mining\\s+exploration\\s+entity') or (regexp_matches(x, '1\\.\\s*cash\\s+flows\\s+from\\s+operating\\s+activities') and regexp_matches(low, 'appendix 5b|quarterly cash flow report|mining exploration entity'))),
        min(page_no) filter (where regexp_matches(low, 'appendix 5b|quarterly cash flow report|mining exploration entity'))) as start_page from l group by document_id),
    sections as (select document_id, start_page, string_agg(text, '\n' order by page_no) as section from l join starts using (document_id) where page_no >= start_page group by document_id, start_page)"""


@query(f"with {SECTIONS} select document_id, start_page, sha256(section) as section_sha256 from sections")
def form_section(s: SparkSession, d: str) -> DataFrame:
    return forms.cashflow_section(pages(s, d)).select("document_id", "start_page", F.sha2("section", 256).alias("section_sha256"))


NUM = "(\\(?-?\\d[\\d,]*\\.?\\d*\\)?)"
FOUND = {"receipts": "1\\.1", "operating": "1\\.9", "exploration_evaluation": "2\\.1\\s*\\(?\\s*d\\s*\\)?", "investing": "2\\.6", "financing": "3\\.10", "cash": "4\\.6"}
RAW = ", ".join(f"nullif(regexp_extract(section, '(?i){p}\\s+.*?{NUM}', 1), '') as {n}_raw" for n, p in FOUND.items())
ITEMS = f"""raw as (select document_id, {RAW}, nullif(regexp_extract(section, '(?i)7\\.4\\s+.*?{NUM}(?:\\s+{NUM})?', 2), '') as f_raw, nullif(regexp_extract(section, '(?i)7\\.1\\s+.*?{NUM}(?:\\s+{NUM})?', 2), '') as l_raw,
        nullif(regexp_extract(section, '(?i)8\\.7\\s+[^\\n(]*?(?:\\([^)\\n]*\\))?\\s*([\\d,]+\\.?\\d*|N/?A|not applicable|nil|>\\s*\\d+)', 1), '') as q_raw,
        nullif(regexp_extract(substr(section, 1, 1500), '(?is)quarter\\s+ended.*?(\\d{{1,2}}\\s+\\w+\\s+\\d{{4}})', 1), '') as d_raw from sections),
    items as (select document_id, {', '.join(f'{AMOUNT.format(n + "_raw")} as {n}' for n in FOUND)}, coalesce(case when {AMOUNT.format('f_raw')} > 0 then {AMOUNT.format('f_raw')} end, case when {AMOUNT.format('l_raw')} > 0 then {AMOUNT.format('l_raw')} end) as debt,
        {FUNDING.format('q_raw')} as quarters_of_funding, cast(coalesce(try_strptime(d_raw, '%d %B %Y'), try_strptime(d_raw, '%d %b %Y')) as date) as effective_date from raw)"""
NAMES = (*FOUND, "debt", "quarters_of_funding")


def _items(s: SparkSession, d: str) -> DataFrame:
    sections = forms.cashflow_section(pages(s, d))
    return sections.select("document_id", *[c.alias(n) for n, c in forms.cashflow_items(F.col("section")).items()])


@query(f"with {SECTIONS}, {ITEMS} select document_id, {', '.join(NAMES)} from items")
def cashflow_items(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("document_id", *NAMES)


@query(f"with {SECTIONS}, {ITEMS} select document_id, effective_date from items")
def quarter_ended(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("document_id", "effective_date")


@query(f"with {SECTIONS}, {ITEMS} select document_id, quarters_of_funding, quarters_of_funding < 2 as short from items where quarters_of_funding is not null")
def quarters_of_funding(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).where("quarters_of_funding is not null").select("document_id", "quarters_of_funding", (F.col("quarters_of_funding") < 2).alias("short"))


SPLIT = "split as (select document_id, row_no, string_split(cells, '|') as c from form_rows)"
NUMS = f"numbers as (select document_id, row_no, trim(c[1]) as ref, list_filter(list_transform(c[2:], lambda x: {AMOUNT.format('x')}), lambda x: x is not null) as n, list_filter(c[2:], lambda x: trim(x) <> '')[-1] as last from split)"
PICK = "arg_min(case when len(n) >= 2 then n[-2] else n[-1] end, row_no) filter (where regexp_matches(ref, '^{0}')) as {1}"
TABLE = f"""{SPLIT}, {NUMS}, tabled as (select document_id, {', '.join(PICK.format(p, n) for p, n in (('1\\.1', 'receipts'), ('1\\.9', 'operating'), ('2\\.6', 'investing'), ('4\\.6', 'cash')))},
        coalesce(arg_min(case when len(n) >= 2 then n[-1] end, row_no) filter (where regexp_matches(ref, '^7\\.4')), arg_min(case when len(n) >= 2 then n[-1] end, row_no) filter (where regexp_matches(ref, '^7\\.1'))) as debt,
        arg_min({FUNDING.format('last')}, row_no) filter (where regexp_matches(ref, '^8\\.7')) as quarters_of_funding from numbers group by document_id)"""


def _tabled(s: SparkSession, d: str) -> DataFrame:
    return forms.cashflow_rows(view(s, d, "form_rows").withColumn("cells", F.split("cells", "[|]")))


@query(f"with {TABLE} select * from tabled")
def cashflow_rows(s: SparkSession, d: str) -> DataFrame:
    return _tabled(s, d).select("document_id", "receipts", "operating", "investing", "cash", "debt", "quarters_of_funding")


FILL = ("receipts", "operating", "investing", "cash", "debt", "quarters_of_funding")


@query(f"with {SECTIONS}, {ITEMS}, {TABLE} select a.document_id, {', '.join(f'case when a.cash is null or a.operating is null or a.investing is null then coalesce(a.{c}, b.{c}) else a.{c} end as {c}' for c in FILL)} from tabled a left join items b on b.document_id = a.document_id")
def fill_missing(s: SparkSession, d: str) -> DataFrame:
    return forms.fill_missing(_tabled(s, d), _items(s, d), FILL)


@query(f"with {SPLIT}, {NUMS} select document_id, row_no, case when len(n) >= 2 then n[-1] end as debt from numbers where regexp_matches(ref, '^7')")
def drawn_debt(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "form_rows").withColumn("c", F.split("cells", "[|]")).where(F.get("c", F.lit(0)).rlike("^7"))
    numbers = F.array_compact(F.transform(F.slice("c", F.lit(2), F.size("c")), t.parse_amount))
    return rows.select("document_id", "row_no", forms.drawn_debt(numbers).alias("debt"))


@query(f"""with {SECTIONS}, {ITEMS}, {SPLIT}, {NUMS}, begun as (select document_id, arg_min(case when len(n) >= 2 then n[-2] else n[-1] end, row_no) as cash_beginning from numbers where regexp_matches(ref, '^\\s*4\\.1\\b') group by document_id)
    select document_id, effective_date, quarters_of_funding, cash * 1000 as cash, cash_beginning * 1000 as cash_beginning, debt * 1000 as debt, receipts * 1000 as receipts_from_customers, financing * 1000 as quarterly_financing, operating * -1000 as quarterly_opex_burn, investing * -1000 as quarterly_invest_burn, exploration_evaluation * -1000 as exploration_evaluation
    from items left join begun using (document_id)""")
def finalize_cashflow(s: SparkSession, d: str) -> DataFrame:
    begun = _tabled(s, d).select("document_id", "cash_beginning")
    return forms.finalize_cashflow(_items(s, d).join(begun, "document_id", "left"))


@query(f"select document_id, row_no, k, {AMOUNT.format('cell')} as amount from (select document_id, row_no, unnest(range(0, len(string_split(cells, '|')))) as k, unnest(string_split(cells, '|')) as cell from form_rows)")
def parse_amount(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "form_rows").select("document_id", "row_no", F.posexplode(F.split("cells", "[|]")).alias("k", "cell")).select("document_id", "row_no", "k", t.parse_amount(F.col("cell")).alias("amount"))


@query(f"""with seen as (select document_id, bool_or(page_no <= 2 and regexp_matches(text, '(?i)Appendix\\s*2A\\s*[-–]\\s*Application\\s+for\\s+quotation')) as a, bool_or(page_no <= 2 and regexp_matches(text, '(?i)Appendix\\s*3H\\s*[-–]\\s*Notification\\s+of\\s+cessation')) as h, bool_or(page_no <= 2 and regexp_matches(text, '(?i)Appendix\\s*3G\\s*[-–]\\s*Notification\\s+of\\s+issue')) as g,
    bool_or(regexp_matches(text, '(?i)Part\\s*4\\s*[-–]\\s*Issued\\s+capital\\s+following\\s+quotation')) as p4, bool_or(regexp_matches(text, '(?i)Part\\s*3\\s*[-–]\\s*Issued\\s+capital\\s+following\\s+changes')) as p3 from filing_pages group by document_id)
    select document_id, case when a then case when p4 then 'appendix_2a' end when h then case when p3 then 'appendix_3h' end when g then case when p3 then 'appendix_3g' end end as form from seen""")
def form_profile(s: SparkSession, d: str) -> DataFrame:
    return forms.form_profile(pages(s, d))


CAPITAL = """opens as (select document_id, min(page_no) as start_page from filing_pages where regexp_matches(text, '(?i)Part\\s*4\\s*[-–]\\s*Issued\\s+capital\\s+following\\s+quotation|Part\\s*3\\s*[-–]\\s*Issued\\s+capital\\s+following\\s+changes') group by document_id),
    joined as (select document_id, string_agg(text, '\n' order by page_no) as s from filing_pages join opens using (document_id) where page_no >= start_page group by document_id),
    parts as (select document_id, regexp_replace(regexp_replace(s, '(?i)Appendix\\s*2A\\s*[-–]\\s*Application\\s+for\\s+quotation\\s+of\\s+securities\\s*\\d+\\s*/\\s*\\d+', '', 'g'), '(?i)Appendix\\s*3[HG]\\s*[-–].*?\\d+\\s*/\\s*\\d+', '', 'g') as section from joined)"""
SECURITIES = f"""{CAPITAL}, halves as (select document_id, string_split_regex(string_split_regex(section, '(?i)(?:4\\.2\\s+Unquoted\\s+\\+?securities|3\\.2\\s+Unquoted\\s+\\+?equity\\s+securities)')[1], '(?i)(?:4\\.1\\s+Quoted\\s+\\+?securities|3\\.1\\s+Quoted\\s+\\+?equity\\s+securities)')[2] as qp,
        string_split_regex(section, '(?i)(?:4\\.2\\s+Unquoted\\s+\\+?securities|3\\.2\\s+Unquoted\\s+\\+?equity\\s+securities)')[2] as up from parts),
    lined as (select document_id, true as quoted, unnest(string_split(qp, '\n')) as line, unnest(range(0, len(string_split(qp, '\n')))) as line_no from halves union all select document_id, false, unnest(string_split(up, '\n')), unnest(range(0, len(string_split(up, '\n')))) from halves),
    hits as (select *, case when quoted then regexp_extract(line, '^([A-Z0-9]{{2,6}})\\s*:\\s*([A-Z][A-Z0-9 .\\-/()]+?)\\s+([\\d,]+)\\s*$', ['code', 'd', 'n']) else regexp_extract(line, '^([A-Z0-9]{{3,8}})\\s*:\\s*(.+?)\\s+([\\d,]+)\\s*$', ['code', 'd', 'n']) end as r from lined),
    named as (select document_id, quoted, line_no, r.code as code, trim(r.d) as description, cast(replace(r.n, ',', '') as bigint) as total_on_issue from hits where r.code <> ''),
    kinds as (select *, case when quoted then case when regexp_matches(description, '(?i)\\boption\\b|\\bwarrant\\b') then 'option' when regexp_matches(description, '(?i)\\bperformance\\s+right') then 'performance_right' when regexp_matches(description, '(?i)\\bconvertible\\s+note') then 'convertible_note' else 'share' end
        when regexp_matches(description, '^OPTION\\s+EXPIRING\\s+\\d{{2}}-[A-Z]{{3}}-\\d{{4}}\\s+EX\\s+\\$\\d+\\.\\d+$') then 'option' when regexp_matches(description, '^CONVERTIBLE\\s+NOTES?$') then 'convertible_note' when regexp_matches(description, '^PERFORMANCE\\s+RIGHTS?(?:\\s+EXPIRING\\s+\\d{{2}}-[A-Z]{{3}}-\\d{{4}})?$') then 'performance_right' else 'other' end as kind from named),
    securities as (select *, case when kind in ('option', 'performance_right') then cast(try_strptime(nullif(regexp_extract(description, 'EXPIRING\\s+(\\d{{2}}-[A-Z]{{3}}-\\d{{4}})', 1), ''), '%d-%b-%Y') as date) end as expiry_date, case when kind = 'option' then try_cast(nullif(regexp_extract(description, 'EX\\s+\\$([\\d.]+)', 1), '') as decimal(18, 6)) end as strike from kinds)"""


def _securities(s: SparkSession, d: str) -> DataFrame:
    return forms.security_rows(forms.capital_section(pages(s, d)))


@query(f"with {SECURITIES} select document_id, quoted, line_no, code, description, total_on_issue, kind, expiry_date, cast(strike as double) as strike, case when kind = 'other' then 'unquoted_row_unparsed' when kind = 'option' and not quoted and expiry_date is null then 'option_unparsed_expiry' end as warning from securities")
def security_rows(s: SparkSession, d: str) -> DataFrame:
    return _securities(s, d).withColumn("strike", F.col("strike").cast("double"))


@query(f"with {CAPITAL} select document_id, length(section) as n, sha256(section) as section_sha256 from parts")
def strip_furniture(s: SparkSession, d: str) -> DataFrame:
    return forms.capital_section(pages(s, d)).select("document_id", F.length("section").alias("n"), F.sha2("section", 256).alias("section_sha256"))


TOTALS = f"{SECURITIES}, totals as (select document_id, cast(coalesce(sum(total_on_issue) filter (where kind = 'share'), 0) as bigint) as shares_basic, cast(sum(total_on_issue) as bigint) as shares_fd, cast(coalesce(sum(total_on_issue) filter (where kind = 'option'), 0) as bigint) as options_outstanding, cast(coalesce(sum(total_on_issue) filter (where kind = 'convertible_note'), 0) as bigint) as convertible_notes, cast(coalesce(sum(total_on_issue) filter (where kind = 'performance_right'), 0) as bigint) as performance_rights from securities group by document_id)"


@query(f"with {TOTALS} select *, case when shares_basic = 0 then 'no_quoted_classes_parsed' else 'ok' end as status from totals")
def capital_totals(s: SparkSession, d: str) -> DataFrame:
    return forms.capital_totals(_securities(s, d))


@query(f"with {TOTALS} select document_id, convertible_notes > 0 as needs_review, case when convertible_notes > 0 then 'missing_shares_fd; cn_present_fd_unreliable' else 'missing_shares_fd' end as review_reason from totals")
def notes_flag(s: SparkSession, d: str) -> DataFrame:
    review, reason = forms.notes_flag(F.lit(False), F.lit("missing_shares_fd"), F.col("convertible_notes"))
    return forms.capital_totals(_securities(s, d)).select("document_id", review.alias("needs_review"), reason.alias("review_reason"))


OLD = """whole as (select document_id, string_agg(text, '\n' order by page_no) as s from filing_pages group by document_id), olds as (select document_id, unnest(string_split(coalesce(nullif(regexp_extract(s, '(?is)(Part\\s*4\\b.*)', 1), ''), s), '\n')) as line from whole),
    oldrows as (select document_id, trim(regexp_extract(line, '([A-Z0-9]+)\\s*:\\s*(.+?)\\s+(\\d[\\d,]+)\\s*$', 2)) as description, try_cast(replace(regexp_extract(line, '([A-Z0-9]+)\\s*:\\s*(.+?)\\s+(\\d[\\d,]+)\\s*$', 3), ',', '') as double) as n from olds where regexp_matches(line, '([A-Z0-9]+)\\s*:\\s*(.+?)\\s+(\\d[\\d,]+)\\s*$')),
    oldkinds as (select *, case when regexp_matches(description, '(?i)chess\\s+depositary\\s+interest|ordinary\\s+(?:fully\\s+paid\\s+)?share|common\\s+share|fully\\s+paid\\s+ordinary') then 'ordinary' when regexp_matches(description, '(?i)option|warrant') then 'option' when regexp_matches(description, '(?i)performance\\s+right|restricted\\s+stock|RSU') then 'performance_right' end as kind,
        regexp_matches(description, '(?i)chess\\s+depositary\\s+interest|\\bCDI\\b') as cdi, try_cast(nullif(regexp_extract(description, '(\\d+)\\s*:\\s*(\\d+)', 1), '') as double) as a, try_cast(nullif(regexp_extract(description, '(\\d+)\\s*:\\s*(\\d+)', 2), '') as double) as b from oldrows where n >= 100)"""


@query(f"with {OLD} select document_id, description, n, case when cdi and a is not null then n * b / a else n end as shares, case when cdi then case when a is null then 'cdi_ratio_unknown_assumed_1:1' when a <> b then 'cdi_ratio_' || cast(a as bigint) || ':' || cast(b as bigint) end end as warning from oldkinds where kind = 'ordinary'")
def cdi_to_shares(s: SparkSession, d: str) -> DataFrame:
    whole = forms.joined_pages(pages(s, d))
    part = F.coalesce(f.found(F.col("section"), r"(?is)(Part\s*4\b.*)"), F.col("section"))
    line = whole.select("document_id", F.explode(F.split(part, "\n")).alias("line")).where(F.col("line").rlike(f.TOTAL_LINE))
    r = line.select("document_id", F.trim(F.regexp_extract("line", f.TOTAL_LINE, 2)).alias("description"), f.count_of(F.regexp_extract("line", f.TOTAL_LINE, 3)).alias("n")).where("n >= 100")
    r = r.where(f.security_class(F.col("description")) == "ordinary")
    return r.withColumns({"shares": f.cdi_shares(F.col("description"), F.col("n")), "warning": f.cdi_warning(F.col("description"))})


@query(f"with {OLD} select document_id, sum(case when cdi and a is not null then n * b / a else n end) filter (where kind = 'ordinary') as total_shares, sum(n) filter (where kind = 'option') as total_options, sum(n) filter (where kind = 'performance_right') as total_rights from oldkinds where kind is not null group by document_id")
def security_totals(s: SparkSession, d: str) -> DataFrame:
    return forms.security_totals(pages(s, d))


CLASS = "case when {0} is not null then case when regexp_matches({0}, '(?i)chess\\s+depositary\\s+interest|ordinary\\s+(?:fully\\s+paid\\s+)?share|common\\s+share|fully\\s+paid\\s+ordinary') then 'ordinary' when regexp_matches({0}, '(?i)option|warrant') then 'option' when regexp_matches({0}, '(?i)performance\\s+right|restricted\\s+stock|RSU') then 'performance_right' else 'other' end end"


@query(f"""with r as (select document_id, nullif(regexp_extract(text, '(?i)(?:number\\s+of\\s+\\+?securities\\s+(?:to\\s+be\\s+(?:issued|quoted|transferred))?)\\s*\\n?\\s*(\\d[\\d,]+)', 1), '') as n, nullif(regexp_extract(text, '(?i)(?:issue\\s+price|exercise\\s+price|consideration)[^\\d$]*?(?:AUD|A\\$|\\$)\\s*([\\d.]+)', 1), '') as p,
        nullif(regexp_extract(text, '(?i)(?:issue\\s+date|date\\s+.*?issued)\\s*\\n?\\s*(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), '') as d, nullif(regexp_extract(text, '(?i)FROM\\s+\\(Existing\\s+Class\\)\\s*\\n?\\s*.*?\\n?\\s*[A-Z0-9]+\\s*:\\s*(.+?)(?:\\n|$)', 1), '') as f, nullif(regexp_extract(text, '(?i)TO\\s+\\(Existing\\s+Class\\)\\s*\\n?\\s*.*?\\n?\\s*[A-Z0-9]+\\s*:\\s*(.+?)(?:\\n|$)', 1), '') as t from filing_pages where page_no = 1)
    select document_id, try_cast(replace(n, ',', '') as double) as issued_count, try_cast(p as double) as issue_price, cast(try_strptime(d, '%d/%m/%Y') as date) as issue_date, {CLASS.format('f')} as converted_from, {CLASS.format('t')} as converted_to from r""")
def issue_details(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).where("page_no = 1").select("document_id", *[c.alias(n) for n, c in forms.issue_details(F.col("text")).items()])


SCORE = " + ".join([f"case when contains(lower(text), '{w}') then 10 else 0 end" for w in ("company snapshot", "capital structure", "corporate summary", "capitalization summary", "share structure", "corporate snapshot", "capital summary", "key statistics", "company overview")] + [f"case when contains(lower(text), '{w}') then 3 else 0 end" for w in ("shares issued", "shares on issue", "fully diluted", "market cap", "cash", "debt")])
BEST = f"best as (select * from (select *, row_number() over (partition by document_id order by score desc, page_no) as place from (select *, {SCORE} as score from filing_pages) where score >= 3) where place <= 3)"


@query(f"with {BEST} select document_id, page_no, score, place from best")
def top_pages(s: SparkSession, d: str) -> DataFrame:
    return forms.top_pages(pages(s, d)).select("document_id", "page_no", "score", "place")


A = "([A-Z]{0,3}\\$?\\d[\\d,.]*[MBK]?)"
B = "([A-Z]{0,3}\\$?\\d[\\d,.]*\\s*(?:million|billion|[MBK]))"
SCALED = """try_cast(trim(replace(regexp_replace(regexp_replace(ltrim(regexp_replace(trim({0}), '^~+', '')), '^[A-Z]{{0,3}}\\$', ''), '(?i)(billion|million|b|m|k)$', ''), ',', '')) as double)
    * case when regexp_matches(lower({0}), '(billion|b)$') then 1e9 when regexp_matches(lower({0}), '(million|m)$') then 1e6 when regexp_matches(lower({0}), 'k$') then 1e3 else 1 end"""
FIELDS = {
    "shares_basic": "(?:shares?\\s+(?:issued|on\\s+issue|outstanding))\\s*[:\\-–]?\\s*" + A, "shares_fd": "(?:fully\\s+diluted|fd\\s+shares?|diluted\\s+shares?)\\s*[:\\-–]?\\s*" + A,
    "debt": "(?:total\\s+)?(?:net\\s+)?debt\\s*[:\\-–]?\\s*(-?[A-Z]{0,3}\\$?\\d[\\d,.]*[MBK]?)", "options_outstanding": "options?\\s+(?:outstanding|on\\s+issue|issued)\\s*[:\\-–]?\\s*" + A,
    "perf_rights_outstanding": "performance\\s+rights?\\s+(?:outstanding|on\\s+issue|issued)?\\s*[:\\-–]?\\s*" + A,
    "c1": "(?:^|\\s)cash(?:\\s+(?:and\\s+cash\\s+equivalents|position|balance|at\\s+bank))?\\s*[:\\-–]?\\s*" + A, "c2": "cash\\s+(?:and\\s+(?:gold|bullion)\\s+)?(?:on\\s+hand|balance).*?(?:was|of|to)\\s+(?:~\\s*)?" + B,
    "c3": "([A-Z]{0,3}\\$\\d[\\d,.]*[MBK]?)\\d?\\s+cash(?:\\s+(?:&|and)\\s+(?:gold|bullion))?", "c4": "(?:cash|bullion)\\s+.*?balance\\s+.*?(?:of|to)\\s+(?:~\\s*)?" + B, "c5": "cash\\s+on\\s+hand\\s+" + A,
}
CASH = ", ".join(f"nullif({SCALED.format(f'c{k}')}, 0)" for k in range(1, 6))
SNAPSHOT = f"""{BEST}, texts as (select document_id, string_agg(text, '\n' order by place) as s from best group by document_id),
    got as (select document_id, {', '.join(f"nullif(regexp_extract(s, '(?i){p}', 1), '') as {n}" for n, p in FIELDS.items())}, nullif(regexp_extract(s, '(?i)as\\s+(?:at|of)\\s+(\\d{{1,2}}\\s+\\w+\\s+\\d{{4}})', 1), '') as d1, nullif(regexp_extract(s, '(?i)as\\s+(?:at|of)\\s+(\\d{{1,2}}/\\d{{1,2}}/\\d{{4}})', 1), '') as d2 from texts),
    snap as (select document_id, {', '.join(f'{SCALED.format(n)} as {n}' for n in list(FIELDS)[:5])}, coalesce({CASH}, {SCALED.format('c1')}) as cash, cast(coalesce(try_strptime(d1, '%d %B %Y'), try_strptime(d1, '%d %b %Y'), try_strptime(d2, '%d/%m/%Y')) as date) as effective_date from got)"""


@query(f"with {SNAPSHOT} select * from snap where coalesce(shares_basic, 0) <> 0 or coalesce(shares_fd, 0) <> 0 or coalesce(cash, 0) <> 0")
def snapshot_fields(s: SparkSession, d: str) -> DataFrame:
    return forms.snapshot_fields(pages(s, d))


AMOUNTS = "case doc_id % 9 when 0 then concat('A$', cast(doc_id as varchar(20)), 'M') when 1 then concat('~', cast(doc_id as varchar(20)), ' million') when 2 then '1.128 billion' when 3 then concat(cast(doc_id as varchar(20)), 'k') when 4 then '1,234,567' when 5 then 'C$2.7B' when 6 then 'n/a' when 7 then '~$181m' else null end"


@query(f"select doc_id, round({SCALED.format('x')}, 2) as amount from (select doc_id, {AMOUNTS} as x from documents)")
def parse_scaled(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", rounded(t.scaled_amount(F.expr(AMOUNTS)), 2).alias("amount"))


WORDS = " + ".join(f"cast(contains(lower(text), '{w}') as int)" for w in ("measured", "indicated", "inferred", "proven", "proved", "probable", "total"))


@query(f"""select document_id, bool_or(page_no <= 3 and regexp_matches(text, '(?i)Mineral\\s+Resource\\s+Estimate|Ore\\s+Reserve\\s+Estimate|JORC\\s*(?:Code)?\\s*\\(?\\s*201[24]\\s*\\)?|Maiden\\s+(?:Mineral\\s+)?Resource|Resource\\s+(?:Update|Upgrade)|Updated\\s+Mineral\\s+Resource'))
    and not bool_or(page_no = 1 and regexp_matches(text, '(?i)Appendix\\s*5B|Quarterly\\s+Activities?\\s+Report|Notification\\s+of\\s+issue|Appendix\\s*[23][A-H]')) and bool_or(page_no <= 20 and {WORDS} >= 2 and regexp_matches(text, '(?i)\\b\\d+[,.]?\\d*\\s*(?:mt|kt|t|g/t|%|ppm|moz|koz)\\b')) as is_estimate from filing_pages group by document_id""")
def resource_profile(s: SparkSession, d: str) -> DataFrame:
    return forms.resource_profile(pages(s, d))


@query(f"""select document_id, bool_or(page_no <= 3 and regexp_matches(text, '{q(f.STUDY_PROFILE)}')) and (not bool_or(page_no = 1 and regexp_matches(text, '(?i)Appendix\\s*5B|Appendix\\s*3[BHG]|Quarterly\\s+Activities\\s+Report|Half[-\\s]?Year(?:ly)?\\s+Report|Annual\\s+Report')) or bool_or(page_no = 1 and regexp_matches(text, '{q(f.STUDY_PROFILE)}'))) as is_study from filing_pages group by document_id""")
def study_profile(s: SparkSession, d: str) -> DataFrame:
    return forms.study_profile(pages(s, d))


LABEL = "(?i)^\\s*(Measured|Indicated|Inferred|Proven|Proved|Probable|Total|Sub[\\-\\s]?total|Measured\\s*[+&]\\s*Indicated|Indicated\\s*[+&]\\s*Inferred|Proven\\s*[+&]\\s*Probable|Proved\\s*[+&]\\s*Probable)\\b"
ROWS = f"""tlines as (select document_id, page_no, unnest(string_split(text, '\n')) as line, unnest(range(0, len(string_split(text, '\n')))) as line_no from filing_pages),
    cut as (select *, nullif(trim(regexp_extract(line, '{LABEL}', 1)), '') as label, regexp_extract_all(regexp_replace(line, '{LABEL}', ''), '[\\d,]+\\.?\\d*') as numbers, string_split_regex(trim(line), '\\s{{2,}}') as pieces from tlines),
    begun as (select *, min(line_no) filter (where label is not null) over (partition by document_id, page_no) as begins from cut),
    heads as (select document_id, page_no, arg_min(pieces, line_no) as headers from begun where line_no < begins and line_no >= begins - 3 and len(pieces) >= 2 group by all),
    rws as (select *, count(*) over (partition by document_id, page_no) as n_rows from begun where label is not null and len(numbers) > 0),
    modes as (select document_id, page_no, arg_min(k, (-times, k)) as cols from (select document_id, page_no, len(numbers) as k, count(*) as times from rws group by all) group by all),
    tabrows as (select r.document_id, r.page_no, line_no, label, numbers[1:cols] as cells, cols, headers from rws r join modes m on m.document_id = r.document_id and m.page_no = r.page_no left join heads h on h.document_id = r.document_id and h.page_no = r.page_no where n_rows >= 2)"""


@query(f"with {ROWS} select document_id, page_no, line_no, label, array_to_string(cells, '|') as cells, cols as columns, coalesce(array_to_string(headers, '|'), '') as headers from tabrows")
def resource_rows(s: SparkSession, d: str) -> DataFrame:
    return forms.resource_rows(pages(s, d)).withColumns({"cells": F.array_join("cells", "|"), "headers": F.coalesce(F.array_join("headers", "|"), F.lit(""))})


CATEGORY = """case when regexp_matches(lower(label), 'total mineral resource|total ore reserve|total resource|total reserve') then 'Total' when regexp_matches(lower(label), 'measured (\\+|and|&) indicated|measured\\+indicated') then 'Measured+Indicated'
    when regexp_matches(lower(label), 'indicated (\\+|and) inferred|indicated\\+inferred') then 'Indicated+Inferred' when regexp_matches(lower(label), '(proven|proved) (\\+|and) probable|(proven|proved)\\+probable') then 'Proven+Probable' when regexp_matches(lower(label), 'in-situ total|in situ total') then 'In-situ Total'
    when contains(lower(label), 'grand total') then 'Total' when contains(lower(label), 'stockpile') then 'Stockpiles' when contains(lower(label), 'indicated') then 'Indicated' when regexp_matches(lower(label), 'sub-total|sub total') then 'Sub-total' when contains(lower(label), 'measured') then 'Measured' when contains(lower(label), 'inferred') then 'Inferred'
    when contains(lower(label), 'probable') then 'Probable' when contains(lower(label), 'subtotal') then 'Sub-total' when contains(lower(label), 'combined') then 'Total' when regexp_matches(lower(label), 'proven|proved') then 'Proven' when contains(lower(label), 'global') then 'Total' when contains(lower(label), 'total') then 'Total'
    when regexp_matches(lower(label), 'm & i') then 'Measured+Indicated' when regexp_matches(lower(label), 'm\\+i|m&i') then 'Measured+Indicated' when contains(lower(label), 'p+p') then 'Proven+Probable' when contains(lower(label), '2p') then 'Proven+Probable' end"""


@query(f"select document_id, row_no, {CATEGORY} as category from estimate_rows")
def category_norm(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "estimate_rows").select("document_id", "row_no", f.category(F.col("label")).alias("category"))


KIND = "case when regexp_matches(h, 'category|class|deposit|type|area') then 'category' when regexp_matches(h, 'tonnes|mt|kt|tonnage|tons') then 'tonnes' when regexp_matches(h, 'cut-off|cutoff|cut off') then null when regexp_matches(h, 'g/t|%|ppm|lb/t|grade') then 'grade' when regexp_matches(h, 'contained|oz|mlb|metal|ounces') then 'contained' end"
HEADS = "case doc_id % 7 when 0 then 'Category|Tonnes (kt)|Grade (g/t)|Contained (Moz)' when 1 then 'Class|Million tonnes|Cut-off (g/t)|Ni (%)|Ni kt' when 2 then 'Area|Mt|U3O8 ppm|Mlb' when 3 then 'Deposit|tons|lb/t|metal' when 4 then 'x|y' when 5 then '  Li2O  %|Ounces' else 'Type|Mt |Au grade|oz' end"


@query(f"select doc_id, k, {KIND} as kind from (select doc_id, unnest(range(0, len(string_split(hs, '|')))) as k, lower(regexp_replace(trim(unnest(string_split(hs, '|'))), '\\s+', ' ', 'g')) as h from (select doc_id, {HEADS} as hs from documents))")
def column_class(s: SparkSession, d: str) -> DataFrame:
    heads = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split(F.expr(HEADS), "[|]")).alias("k", "h"))
    return heads.select("doc_id", "k", f.column_kind(F.col("h")).alias("kind"))


@query(f"""with h as (select doc_id, list_transform(string_split({HEADS}, '|'), lambda x: lower(regexp_replace(trim(x), '\\s+', ' ', 'g'))) as hs from documents)
    select doc_id, coalesce(list_filter(list_transform(hs, lambda x: case when contains(x, 'g/t') then 'g/t' when contains(x, '%') then '%' when contains(x, 'ppm') then 'ppm' when contains(x, 'lb/t') then 'lb/t' end), lambda x: x is not null)[1], 'g/t') as grade,
        list_filter(list_transform(hs, lambda x: case when contains(x, 'moz') then 'Moz' when contains(x, 'koz') then 'Koz' when contains(x, 'mlb') then 'Mlb' when contains(x, 'kt') then 'Kt' when contains(x, 'oz') then 'Oz' end), lambda x: x is not null)[1] as contained,
        coalesce(list_filter(list_transform(hs, lambda x: case when contains(x, 'kt') and not contains(x, 'million') then 'kt' when contains(x, 'mt') or contains(x, 'million') then 'Mt' end), lambda x: x is not null)[1], 'Mt') as tonnes from h""")
def column_units(s: SparkSession, d: str) -> DataFrame:
    hs = F.split(F.expr(HEADS), "[|]")
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", f.grade_unit(hs).alias("grade"), f.contained_unit(hs).alias("contained"), f.tonnes_unit(hs).alias("tonnes"))


CELL = "try_cast(replace(regexp_replace(trim({0}), '(?i)\\s*(Mt|kt|t|g/t|%|ppm|lb/t|Moz|koz|Mlb|oz)\\s*$', ''), ',', '') as double)"


@query(f"with c as (select document_id, row_no, string_split(cells, '|') as c from form_rows) select document_id, row_no, coalesce({CELL.format('c[3]')}, {CELL.format('c[2]')}, {CELL.format('c[4]')}) as value from c")
def read_cell(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "form_rows").select("document_id", "row_no", f.read_cell(F.split("cells", "[|]"), F.lit(2)).alias("value"))


CARRIED = f"""marked as (select *, {CATEGORY} as category, case when empty and not regexp_matches(lower(label), 'measured|indicated|inferred|proven|proved|probable|total') then regexp_replace(trim(regexp_replace(label, '\\s*\\(.*$', '')), '\\s+', ' ', 'g') end as header from estimate_rows),
    carried as (select *, last_value(header ignore nulls) over (partition by document_id order by row_no rows between unbounded preceding and current row) as carried from marked)"""


@query(f"with {CARRIED} select document_id, row_no, category, case when category not in ('In-situ Total', 'Stockpiles', 'Total') then carried end as section from carried where header is null and category is not null")
def carry_section(s: SparkSession, d: str) -> DataFrame:
    return forms.carry_section(view(s, d, "estimate_rows"))


@query("select document_id, row_no, case document_id % 3 when 0 then tonnes / 1000 when 1 then tonnes / 1000000 else tonnes end as mt from estimate_rows")
def tonnes_to_mt(s: SparkSession, d: str) -> DataFrame:
    k = F.col("document_id") % 3
    return view(s, d, "estimate_rows").select("document_id", "row_no", t.tonnes_to_mt(F.col("tonnes"), F.when(k == 0, "kt").when(k == 1, "t").otherwise("Mt")).alias("mt"))


@query(f"""with c as (select document_id, row_no % 3 as table_no, row_no, {CATEGORY} as category from estimate_rows), m as (select document_id, table_no, bool_or(category in ('Proven', 'Probable', 'Proven+Probable')) as rv, bool_or(category in ('Measured', 'Indicated', 'Inferred', 'Measured+Indicated', 'Indicated+Inferred')) as rs from c where category is not null group by all)
    select document_id, row_no, category, case when rv then 'mixed_resource_reserve_table' end as warning from c join m using (document_id, table_no) where category is not null and (not rv or rs) and not (rv and category in ('Proven', 'Probable', 'Proven+Probable'))""")
def resource_reserve(s: SparkSession, d: str) -> DataFrame:
    rows = view(s, d, "estimate_rows").select("document_id", (F.col("row_no") % 3).alias("table_no"), "row_no", f.category(F.col("label")).alias("category")).where("category is not null")
    return forms.split_reserves(rows).select("document_id", "row_no", "category", "warning")


METAL = "list_filter([" + ", ".join(f"case when regexp_matches(text, '(?i){p}') then '{m}' end" for m, p in (("Au", "\\bgold\\b|(^|[^.])\\bAu\\b"), ("Ag", "\\bsilver\\b|(^|[^.])\\bAg\\b"), ("Cu", "\\bcopper\\b|(^|[^.])\\bCu\\b"), ("Li2O", "\\blithium\\b|\\bLi2?O\\b|\\bLCE\\b"), ("U3O8", "\\buranium\\b|\\bU3O8\\b"), ("Ni", "\\bnickel\\b|(^|[^.])\\bNi\\b"), ("Zn", "\\bzinc\\b|(^|[^.])\\bZn\\b"), ("Fe", "\\biron\\s*ore\\b|(^|[^.])\\bFe\\b"), ("TREO", "\\brare\\s*earth\\b|\\bREE\\b|\\bTREO\\b"), ("Co", "\\bcobalt\\b|(^|[^.])\\bCo\\b"), ("Graphite", "\\bgraphite\\b|\\bTGC\\b"))) + "], lambda x: x is not null)"


@query(f"select document_id, m[1] as commodity, case when len(m) > 1 then 'polymetallic_deposit_detected:' || array_to_string(m, '+') || '_using_' || m[1] end as warning from (select document_id, {METAL} as m from filing_pages where page_no = 1)")
def infer_commodity(s: SparkSession, d: str) -> DataFrame:
    names = f.metals(F.col("text"))
    return pages(s, d).where("page_no = 1").select("document_id", F.get(names, F.lit(0)).alias("commodity"), f.polymetallic_warning(names).alias("warning"))


PROSE = "(length({0}) > 40 or len(string_split_regex(trim({0}), '\\s+')) > 5 or regexp_matches({0}, '^[a-z]') or regexp_matches(lower({0}), '^(the|its|it|all|this|that|both|o|details|relates|release|continues|strike|additional|last|upper|further)(\\s|$)') or regexp_matches(lower({0}), '(^|\\s)(has|was|were|will|expected|confirms|demonstrates|intended|completed|announced|updated|delivers|supports|used|show|unlock|emerge)(\\s|$)'))"


@query(f"""with n as (select document_id, nullif(trim(regexp_extract(text, '(?i)(?:at|for)\\s+(?:the\\s+)?([A-Z][A-Za-z0-9 \\-'']{{2,60}})\\s+(?:Project|Deposit|Mine|Operation)', 1)), '') as a, nullif(trim(regexp_extract(text, '(?im)^([A-Z][A-Za-z0-9 \\-'']{{3,80}}?)\\s+(?:Mineral\\s+Resource|Ore\\s+Reserve|JORC\\s+Resource|Resource\\s+Estimate)', 1)), '') as b from filing_pages where page_no = 1)
    select document_id, coalesce(case when not {PROSE.format('a')} then a end, case when not {PROSE.format('b')} then b end) as project_name from n""")
def project_name_extract(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).where("page_no = 1").select("document_id", forms.project_name(F.col("text")).alias("project_name"))


@query("""with r as (select p.document_id, announcement_date, regexp_extract(p.text, '(?i)cut[\\-\\s]?off\\s+grade\\s*(?:of\\s*)?(\\d+\\.?\\d*)\\s*([a-zA-Z%/]+)', ['n', 'u']) as a, regexp_extract(p.text, '(?i)(\\d+\\.?\\d*)\\s*([a-zA-Z%/]+)\\s*cut[\\-\\s]?off', ['n', 'u']) as b,
        nullif(regexp_extract(p.text, '(?i)(?:effective|as\\s+at|as\\s+of)\\s+(\\d{1,2}\\s+\\w+\\s+\\d{4})', 1), '') as d1, nullif(regexp_extract(p.text, '(?i)(?:effective|as\\s+at|as\\s+of)\\s+(\\d{1,2}/\\d{1,2}/\\d{4})', 1), '') as d2 from filing_pages p join filings f on f.document_id = p.document_id where page_no = 1)
    select document_id, try_cast(case when a.n <> '' then a.n else nullif(b.n, '') end as double) as cutoff, case when a.n <> '' then a.u else nullif(b.u, '') end as unit, coalesce(cast(coalesce(try_strptime(d1, '%d %B %Y'), try_strptime(d1, '%d %b %Y'), try_strptime(d2, '%d/%m/%Y')) as date), announcement_date) as effective_date from r""")
def cutoff_date(s: SparkSession, d: str) -> DataFrame:
    first = pages(s, d).where("page_no = 1").select("document_id", "text").join(view(s, d, "filings").select("document_id", "announcement_date"), "document_id")
    value, unit = forms.cutoff(F.col("text"))
    return first.select("document_id", value.alias("cutoff"), unit.alias("unit"), forms.effective_date(F.col("text"), F.col("announcement_date")).alias("effective_date"))
