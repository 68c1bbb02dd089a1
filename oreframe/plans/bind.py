"""Domain views over the driver's tables. Each is one SQL text that Spark and DuckDB both run, so queries and their SQL start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

VIEWS: dict[str, str] = {
    "companies": "select c_custkey as company_id, concat('T', cast(c_custkey as varchar(20))) as ticker, c_name as company_name from customer",
    "projects": """
        select distinct o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) as bigint) as project_id, o_custkey as company_id,
            case o_custkey % 6 when 0 then 'the Lease ' when 1 then 'upper field ' else 'Granite Hill ' end || substr(o_orderpriority, 1, 1) as project_name,
            case substr(o_orderpriority, 1, 1) when '1' then 'production' when '2' then 'feasibility' when '3' then 'advanced_exploration' when '4' then 'exploration' else 'unknown' end as stage,
            case o_custkey % 3 when 0 then 'Australia' when 1 then 'Canada' else null end as country,
            case o_custkey % 4 when 0 then 'WA' when 1 then 'QLD' else null end as state, case o_custkey % 5 when 0 then 'Pilbara' when 1 then 'Kimberley' else null end as region,
            case when o_custkey % 4 = 1 then cast('1990-01-01' as date) + cast(o_custkey % 4500 as int) else null end as production_start_date,
            case o_custkey % 7 when 0 then 'inferred' when 1 then 'registry' else null end as stage_source
        from orders""",
    "project_commodities": """
        select distinct o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) as bigint) as project_id, case (o_custkey + cast(substr(o_orderpriority, 1, 1) as bigint)) % 4 when 0 then 'Au' when 1 then 'Ag' when 2 then 'Cu' else 'Ni' end as commodity, true as is_primary
        from orders
        union all
        select distinct o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) as bigint), 'Co', false from orders where o_custkey % 3 = 0""",
    "studies": """
        select o_orderkey as study_id, o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) as bigint) as project_id, o_custkey as company_id,
            case when o_orderkey % 41 = 0 then null else cast(o_orderdate as date) end as study_date, cast(o_orderdate as date) as announcement_date,
            case o_orderkey % 8 when 0 then 'DFS' when 1 then 'Updated DFS' when 2 then 'Revised DFS' when 3 then 'FFS' when 4 then 'PFS' when 5 then 'Updated PFS' when 6 then 'Scoping' else 'PEA' end as study_stage,
            case when o_orderkey % 23 = 0 then null when o_orderkey % 27 = 0 then 0.0 when o_orderkey % 43 = 0 then -o_totalprice / 1000.0 else o_totalprice / 1000.0 end as post_tax_npv,
            case when o_orderkey % 19 = 0 then null else o_totalprice / 1000.0 * (0.8 + (o_orderkey % 13) / 10.0) end as pre_tax_npv,
            case when o_orderkey % 17 = 0 then null else o_totalprice / 2000.0 end as initial_capex,
            case when o_orderkey % 47 = 0 then 0.0 else cast(4 + o_orderkey % 9 as double) end as discount_rate_pct, case when o_orderkey % 53 = 0 then null else cast(3 + o_orderkey % 18 as double) end as mine_life_years,
            case when o_orderkey % 5 = 0 then null when o_orderkey % 29 = 0 then 0.3 when o_orderkey % 31 = 0 then 0.0 else cast(25 + o_orderkey % 10 as double) end as tax_rate_pct,
            case when o_orderkey % 59 = 0 then 'CAD' when o_orderkey % 3 = 0 then 'AUD' else 'USD' end as reporting_currency,
            case o_orderkey % 37 when 0 then 'conceptual' when 1 then 'definitive' else null end as header_tier,
            concat('[{"commodity":"Au","price":', cast(100 + o_orderkey % 400 as varchar(20)), ',"unit":"', case o_orderkey % 4 when 0 then 'A$/oz' when 1 then 'US$/oz' else 'USD/oz' end,
                '"},{"commodity":"Ag","price":', cast(10 + o_orderkey % 90 as varchar(20)), ',"unit":"AUD/oz"},{"commodity":"Cu","price":', case o_orderkey % 3 when 0 then cast(5000 + o_orderkey % 5000 as varchar(20)) else cast(1 + o_orderkey % 7 as varchar(20)) end,
                ',"unit":"', case o_orderkey % 6 when 0 then 'USD/t' else 'USD/lb' end, '"},{"commodity":"Pd","price":', cast(50 + o_orderkey % 500 as varchar(20)), ',"unit":null},{"commodity":"Ni","price":', cast(7 + o_orderkey % 9 as varchar(20)), ',"unit":"USD/lb"}',
                case when o_orderkey % 5 = 0 then '' else concat(',{"commodity":"Pt","price":', cast(60 + o_orderkey % 300 as varchar(20)), ',"unit":"USD/oz"}') end,
                case when o_orderkey % 7 = 0 then '' else concat(',{"commodity":"U3O8","price":', cast(20 + o_orderkey % 60 as varchar(20)), ',"unit":"USD/lb"}') end, ']') as assumed_price_deck,
            o_orderkey % 9 = 0 as needs_review, case when o_orderkey % 9 = 0 then case o_orderkey % 2 when 0 then 'post_tax_npv_ge_pre_tax_npv' else null end else null end as review_reason,
            case o_orderkey % 5 when 0 then '2003' when 1 then '2002-06' when 2 then '2001-11-30' when 3 then 'Q3 2004' else null end as first_production,
            case o_orderkey % 6 when 0 then null when 1 then -10.0 else cast(900 + o_orderkey % 300 as double) end as aisc, case o_orderkey % 4 when 0 then 'A$/oz (US$/oz)' when 1 then 'AUD/oz' else 'US$/oz' end as aisc_unit,
            cast(o_orderkey % 97 as double) * 3.5 as annual_production, case o_orderkey % 6 when 0 then 'koz/yr' when 1 then 'Moz pa' when 2 then 't/yr' when 3 then 'ktpa contained' when 4 then 'Mlb' else null end as annual_production_unit,
            o_orderkey % 200 as document_id,
            case when o_orderkey % 10 = 0 then null when o_orderkey % 12 = 5 then 'conceptual' when o_orderkey % 15 = 7 then 'definitive'
                when o_orderkey % 8 < 4 then 'definitive' when o_orderkey % 8 < 6 then 'indicative' else 'conceptual' end as study_confidence_tier
        from orders""",
    "study_commodities": """
        select l_orderkey as study_id, l_linenumber as leg,
            case l_linenumber when 1 then 'Au' when 2 then 'Ag' when 3 then 'Cu' when 4 then 'Pd' when 5 then 'Pt' when 6 then 'U3O8' else 'Ni' end as commodity,
            case when (l_orderkey + l_linenumber) % 11 = 0 then null else sum(l_quantity) * case l_linenumber when 1 then 200.0 when 2 then 2.0 when 3 then 2.0 when 4 then 1000.0 when 5 then 20000.0 when 6 then 10000.0 else 1000.0 end end as annual_production,
            l_linenumber = 1 as is_primary
        from lineitem group by l_orderkey, l_linenumber""",
    "commodity_prices": """
        select event_id as price_id, case event_type when 'view' then 'Au' when 'click' then 'Ag' when 'signup' then case when user_id % 2 = 0 then 'Cu' else 'Pd' end
            when 'purchase' then case when user_id % 2 = 0 then 'Pt' else 'U3O8' end else 'AUDUSD' end as commodity,
            case event_type when 'error' then value / 1000.0 + 0.5 else value end as price_usd, ts as fetched_at, user_id % 10 as series from events""",
    "company_financials": """
        select o_orderkey as financial_id, o_custkey as company_id, o_orderkey % 170 as document_id, cast(o_orderdate as date) as effective_date,
            case when o_orderkey % 11 = 0 then null else o_totalprice end as cash,
            case o_orderstatus when 'O' then -o_totalprice / (2 + o_orderkey % 7) when 'P' then null else o_totalprice / (2 + o_orderkey % 7) end as burn,
            case when o_orderkey % 4 in (0, 3) or o_orderkey % 13 = 0 then null else cast(1000 + o_orderkey % 5000 as double) end as shares_fd,
            case when o_orderkey % 4 = 0 then 'appendix_5b' when o_orderkey % 4 = 1 then 'issue_of_securities' when o_orderkey % 4 = 2 then 'presentation' else 'quarterly_activity' end as doc_type,
            case when o_orderkey % 3 = 0 then o_totalprice * 20 else null end as receipts,
            o_orderkey % 6 = 0 as needs_review,
            case o_orderkey % 7 when 0 then 'missing:cash; npv_ge_pre' when 1 then 'implied_tax_gap:0.6;change' when 2 then 'missing_shares_fd; missing_cash' when 3 then 'missing_opex_burn; cash_50pct_deviation' else null end as review_reason
        from orders""",
    "revals": """
        select o_orderkey * 10 as revaluation_id, o_orderkey as study_id, o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) as bigint) as project_id, o_custkey as company_id,
            cast(o_orderdate as timestamp) as computed_at, case o_orderkey % 3 when 0 then 'Au' else 'Cu' end as commodity, o_totalprice / 4000.0 as npv_dfs, o_totalprice / 900.0 as npv_spot, o_totalprice / 9000.0 - 10 as npv_uplift, cast(o_orderkey % 31 as double) / 10 - 0.5 as npv_uplift_pct,
            case o_orderkey % 11 when 0 then null else cast(o_orderkey % 10000 as bigint) end as price_spot_id, cast(100 + o_orderkey % 300 as double) as price_dfs, cast(150 + o_orderkey % 500 as double) as price_spot,
            concat('["coverage_pct:', cast(40 + o_orderkey % 61 as varchar(20)), '.0"', case o_orderkey % 4 when 0 then ',"partial_basket_coverage:80.0pct"' else '' end, case o_orderkey % 5 when 0 then ',"deck_far_below_spot_Au:100_vs_500"' else '' end, case o_orderkey % 9 when 0 then ',"study_needs_review:x"' else '' end, ']') as warnings,
            case o_orderkey % 8 when 6 then 'conceptual' when 7 then null when 4 then 'indicative' when 5 then 'indicative' else 'definitive' end as study_confidence_tier
        from orders where o_orderkey % 3 <> 1
        union all
        select o_orderkey * 10 + 1, o_orderkey, o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) as bigint), o_custkey, cast(o_orderdate as timestamp) + interval 400 day, 'Au', o_totalprice / 4000.0, o_totalprice / 800.0, o_totalprice / 8000.0, cast(o_orderkey % 29 as double) / 10,
            cast(o_orderkey % 10000 as bigint), cast(200 as double), cast(300 as double), '["coverage_pct:100.0"]', 'definitive'
        from orders where o_orderkey % 6 = 2""",
    "resources": """
        select l_orderkey * 10 + l_linenumber as resource_id, l_orderkey as study_id, l_partkey % 500 as project_id, cast(l_shipdate as date) as effective_date,
            case l_returnflag when 'A' then 'Measured' when 'N' then 'Indicated' else 'Inferred' end as category,
            case l_linenumber when 1 then 'Au' when 2 then 'Ag' else 'Cu' end as commodity, l_quantity as tonnes, l_discount * 100 as grade
        from lineitem""",
    "filings": """
        select doc_id as document_id, concat('T', cast(doc_id % 97 as varchar(20))) as ticker,
            case doc_id % 24 when 0 then 'Appendix 5B cash flow' when 1 then 'DFS confirms strong project' when 2 then 'Pre-Feasibility Study results' when 3 then 'Scoping Study update'
                when 4 then 'Appendix 2A' when 5 then 'Placement completed' when 6 then 'Maiden resource at Peak' when 7 then 'Half Year accounts' when 8 then 'Annual Report'
                when 9 then 'Quarterly Activities' when 10 then 'Feasibility Study delivered' when 11 then 'PEA for Repeat Hill' when 12 then null when 13 then 'Prefeasibility Study delivered'
                when 14 then 'Scoping level feasibility study' when 15 then 'Corporate Presentation' when 16 then 'Q1 highlights' when 17 then 'March Quarter wrap' when 18 then 'Investment Update' when 19 then 'Granite Hill 3 drilling'
                when 20 then '  ' else substr(text, 1, 40) end as header,
            concat('https://asx.example/', cast(doc_id as varchar(20)), '.pdf') as url,
            case when doc_id % 31 = 0 then null else cast('1998-01-01' as date) + cast(doc_id % 1300 as int) end as announcement_date,
            case doc_id % 9 when 0 then 'appendix_5b' when 1 then 'study_dfs' when 2 then 'study_pfs' when 3 then 'study_scoping' when 4 then 'issue_of_securities' when 5 then 'resource_update' when 6 then 'presentation' when 7 then 'quarterly_activity' else 'other' end as doc_type,
            case doc_id % 6 when 0 then 'parsed' when 1 then 'failed' when 2 then 'pending' when 3 then 'classified' when 4 then 'retry_scheduled' else 'skipped' end as parse_status,
            case doc_id % 8 when 0 then 'llm_api_error:429 RESOURCE_EXHAUSTED' when 1 then 'minimum_data_missing:no npv' when 2 then 'pdf_error:bad(xref)' when 3 then 'Download_Failed: 404' else null end as parse_error,
            cast(doc_id % 7 as int) as retry_count, cast(doc_id % 50 as int) as due_in_hours, source, text from documents""",
    "forks": """
        select distinct o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) as bigint) as project_id, o_custkey as company_id, case o_custkey % 4 when 0 then 'Vulcan Energy Limited' when 1 then 'Ra Ltd' when 2 then null else 'Paris Gold NL' end as company_name,
            case substr(o_orderpriority, 1, 1) when '1' then case o_custkey % 3 when 0 then 'Granite Hill Gold Project' else 'Paris Deposit' end when '2' then 'GRANITE HILL' when '3' then 'Vulcan Granite Hill' when '4' then case o_custkey % 2 when 0 then 'Paris Ni-Cu – PGE' else 'later in the year' end else 'Gold Mine' end as project_name,
            o_custkey % 10 + cast(substr(o_orderpriority, 1, 1) as bigint) as created_at
        from orders""",
    "stage_inferences": """
        select distinct o_custkey * 100 + cast(substr(o_orderpriority, 1, 1) as bigint) * 10 + o_orderkey % 3 as inference_id, o_custkey * 10 + cast(substr(o_orderpriority, 1, 1) as bigint) as project_id,
            case o_orderkey % 3 when 0 then 'exploration' when 1 then 'development' else null end as inferred_stage
        from orders""",
    "filing_pages": """
        select doc_id as document_id, 1 as page_no, case doc_id % 12
            when 0 then concat('Appendix 5B
Mining exploration entity or oil and gas exploration entity quarterly cash flow report
Quarter ended (current quarter)
', case doc_id % 5 when 0 then '30 SEPTEMBER 2000' when 1 then '31 Dec 2000' when 2 then '31 March 1999' when 3 then '15 May 1999' else '31 Foo 2000' end)
            when 1 then 'Quarterly Activities Report
Highlights of the period'
            when 2 then case doc_id % 3 when 0 then 'Appendix 4C quarterly
under rule 5.5' when 1 then 'Half Yearly Report and Appendix 4D' else 'Directors'' Report and a Notification of issue' end
            when 3 then 'Appendix 2A - Application for quotation of securities'
            when 4 then case doc_id % 2 when 0 then 'Appendix 3H - Notification of cessation of securities' else 'Appendix 3G – Notification of issue' end
            when 5 then concat('Company Snapshot as at ', case doc_id % 3 when 0 then '16 FEBRUARY 2001' when 1 then '3/4/2001' else 'today' end, '
Shares on issue: ', cast(200 + doc_id % 90 as varchar(20)), '.5M
Fully diluted ', cast(300 + doc_id % 90 as varchar(20)), 'M
Cash A$', cast(1 + doc_id % 150 as varchar(20)), 'M
Total Debt: $5,000,000
Options outstanding 12.5M')
            when 6 then concat('Maiden Mineral Resource for the Granite Hill Deposit
Gold and copper at a cut-off grade of 0.', cast(1 + doc_id % 9 as varchar(20)), ' g/t Au, effective ', case doc_id % 2 when 0 then '1 March 2001' else '01/03/2001' end)
            when 7 then case doc_id % 5 when 0 then 'Definitive Feasibility Study results' when 1 then 'Annual Report
with a PFS inside' else 'Scoping Study for the Lake Mine' end
            when 8 then 'Updated Mineral Resource at the upper lens has expected Project
1.5 % cut-off for nickel and cobalt as of 30 June 2000'
            when 9 then concat('Strong quarter: cash and gold on hand was ~$', cast(1 + doc_id % 700 as varchar(20)), '.6 million at the end')
            when 10 then 'Annual Report of the year'
            else concat('Number of +securities to be issued
', cast(1000 + doc_id as varchar(20)), '
Issue price per +security: AUD 0.', cast(10 + doc_id % 80 as varchar(20)), '
Issue date
', cast(1 + doc_id % 28 as varchar(20)), '/6/2000
FROM (Existing Class)
ABCAA : OPTION EXPIRING VARIOUS
TO (Existing Class)
ABC : ORDINARY FULLY PAID
Part 4 of the form
ABC : CHESS DEPOSITARY INTERESTS ', case doc_id % 3 when 0 then '10:1' when 1 then '1:1' else 'each' end, '  1', lpad(cast(doc_id % 1000 as varchar(20)), 3, '0'), ',000
ABCX : COMMON SHARES 5,000
ABCAA : OPTION EXPIRING VARIOUS DATES 11,170,000
ABCAB : RESTRICTED STOCK UNITS 250,000
PAGE : OF 12') end as text
        from documents
        union all
        select doc_id, 2, case doc_id % 12
            when 0 then concat('1. Cash flows from operating activities
1.1 Receipts from customers ', cast(doc_id % 900 as varchar(20)), ' 1,800
1.9 Net cash from / (used in) operating activities (', cast(1 + doc_id % 9 as varchar(20)), ',', lpad(cast(doc_id % 1000 as varchar(20)), 3, '0'), ') (9,345)
2.1 (d) exploration and evaluation (500) (900)
2.6 Net cash from investing activities -', cast(doc_id % 700 as varchar(20)), ' -10
3.10 Net cash from financing activities 2,500 2,500
4.6 Cash and cash equivalents at end of period ', cast(1 + doc_id % 50 as varchar(20)), ',', lpad(cast(doc_id % 1000 as varchar(20)), 3, '0'), ' 77
7.4 Total financing facilities 5,000', case doc_id % 2 when 0 then concat(' ', cast(1 + doc_id % 4000 as varchar(20))) else '' end, '
8. Estimated cash available
8.7 Estimated quarters of funding available (Item 8.6 divided by Item 8.5) ', case doc_id % 4 when 0 then '3.2' when 1 then 'N/A' when 2 then '> 50' else '7' end)
            when 1 then concat('Appendix 5B – Mining exploration entity
1. Cash flows from operating activities
1.9 Net cash (', cast(doc_id % 500 as varchar(20)), ')
4.6 Cash at end of quarter ', cast(doc_id % 800 as varchar(20)), '
', case doc_id % 3 when 0 then 'ASX Listing Rules Appendix 5B (17/07/20)' else 'page two' end)
            when 3 then concat('Part 4 - Issued capital following quotation
4.1 Quoted +securities
ABC : ORDINARY FULLY PAID ', cast(1 + doc_id % 9 as varchar(20)), ',234,567
ABCO : OPTION EXPIRING 07-OCT-2028 EX $0.25 5,000,000
4.2 Unquoted +securities
ABCAA : OPTION EXPIRING 31-DEC-2027 EX $0.', cast(10 + doc_id % 80 as varchar(20)), ' 1,000,000
ABCAB : PERFORMANCE RIGHTS EXPIRING 01-JAN-2029 ', cast(100 + doc_id % 800 as varchar(20)), ',000
ABCAC : CONVERTIBLE NOTES ', case doc_id % 2 when 0 then '40' else '0' end, '
ABCAD : DEFERRED SHARES CLASS B 7,000
Appendix 2A - Application for quotation of securities 6 / 7')
            when 4 then concat('Part 3 - Issued capital following changes
3.1 Quoted +equity securities
', case doc_id % 5 when 0 then 'no rows' else concat('XYZ : COMMON SHARES ', cast(2 + doc_id % 9 as varchar(20)), '00,000') end, '
3.2 Unquoted +equity securities
XYZAA : PERFORMANCE RIGHTS 1,000
XYZAB : OPTION EXPIRING 31-FEB-2027 EX $1.50 2,000')
            when 5 then 'Key statistics and capital structure
Performance rights issued 5.2M'
            when 6 then concat('Table one
Classification  Tonnes (Mt)  Grade (g/t)  Contained (koz)
Measured ', cast(1 + doc_id % 9 as varchar(20)), '.5 1.2 58
Indicated 12.0 1.0 ', cast(300 + doc_id % 200 as varchar(20)), '
Inferred 3.25 0.8 84
Total 16.75 1.1 528')
            when 8 then concat('Deposit type  kt  %  kt metal
Proven 100 2.0 2
Probable ', cast(doc_id % 900 as varchar(20)), ' 1.5 3
Measured + Indicated 1,200 1.1
Total 1,500 1.0')
            else 'Notes to the page before' end
        from documents
        union all
        select doc_id, 3, text from documents""",
    "form_rows": """
        select doc_id as document_id, 1 as row_no, concat('1.1|Receipts|', cast(doc_id % 900 as varchar(20)), '|1,800') as cells from documents where doc_id % 2 = 0
        union all select doc_id, 2, concat('1.9 |Net cash|(', cast(doc_id % 700 as varchar(20)), ')|', case doc_id % 3 when 0 then '(900)' else '-' end) from documents
        union all select doc_id, 3, concat('2.6|Net investing|', case doc_id % 4 when 0 then 'nil|' when 1 then '(5|' else concat(cast(doc_id % 300 as varchar(20)), '|') end) from documents
        union all select doc_id, 4, concat('4.6|Cash at end|', cast(doc_id % 5000 as varchar(20)), '|', cast(doc_id % 7000 as varchar(20))) from documents where doc_id % 5 <> 0
        union all select doc_id, 5, concat('7.4|Facilities|5,000|', case doc_id % 3 when 0 then '' else cast(doc_id % 4000 as varchar(20)) end) from documents where doc_id % 4 <> 1
        union all select doc_id, 8, concat('4.1 |Cash at beginning|', cast(doc_id % 6000 as varchar(20)), '|', case doc_id % 4 when 0 then '' else cast(doc_id % 8000 as varchar(20)) end) from documents where doc_id % 3 <> 1
        union all select doc_id, 6, concat('7.1|Loans|800|', cast(doc_id % 90 as varchar(20))) from documents
        union all select doc_id, 7, concat('8.7|Quarters||', case doc_id % 4 when 0 then '3.2' when 1 then 'N/A' when 2 then '> 50' else '1,007' end) from documents""",
    "estimate_rows": """
        select doc_id as document_id, doc_id % 4 as table_no, row_no, label, tonnes, grade, contained, case doc_id % 2 when 0 then 'g/t' else '%' end as grade_unit, case doc_id % 6 when 0 then 'koz' when 1 then 'kt' when 2 then 'Moz' when 3 then 'Mlb' when 4 then 'lb' else null end as unit,
            case doc_id % 5 when 0 then 'Au' when 1 then 'Cu' when 2 then 'Ni' when 3 then 'U3O8' else 'Co' end as commodity, tonnes is null as empty, coalesce(cast(doc_id % 300 * 10 + 1 as bigint), 0) as project_id
        from documents cross join (
            select 1 as row_no, 'North Pit (0.5 g/t cut-off)' as label, cast(null as double) as tonnes, cast(null as double) as grade, cast(null as double) as contained
            union all select 2, 'Measured', 2.5, 1.2, 96.45 union all select 3, 'Indicated resource', 7.5, 0.8, 192.9 union all select 4, 'Sub-total', 10.0, 0.9, 289.4
            union all select 5, 'South  Pit', null, null, null union all select 6, 'Inferred', 4.0, 0.02, 2.6 union all select 7, 'Proved + Probable', 3.0, 35.0, 30.0 union all select 8, 'Probable', 1.0, 1.1, 11.0 union all select 9, 'Grand Total', 14.5, 0.9, 400.0 union all select 10, 'Remarks', 1.0, 1.0, 1.0) as t
        where row_no < 10 or doc_id % 3 = 0""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Its schema is read from the files once, as a query reads some tables many times."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str, dealt: tuple[int, str] | None = None) -> DataFrame:
    """A domain view over the tables in sf_dir. dealt (parts, key) deals a table's rows by its key before the view works out its columns, which are wider."""
    sql, used = VIEWS[name].replace("{", "{{").replace("}", "}}"), []
    for t in TABLES:
        sql, n = re.subn(rf"\b(from\s+){t}\b", rf"\1{{{t}}}", sql)
        used += [t] if n else []
    tables = {t: table(spark, sf_dir, t) for t in used}
    return spark.sql(sql, **{t: rows.repartition(*dealt) if dealt else rows for t, rows in tables.items()})


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views that it names."""
    used = [f"{n} as ({v})" for n, v in VIEWS.items() if re.search(rf"\b{n}\b", sql) and not re.search(rf"\b{n} as \(", sql)]
    if not used:
        return sql
    return "with " + ", ".join(used) + (", " if sql.lstrip().startswith("with ") else " ") + re.sub(r"^\s*with ", "", sql)
