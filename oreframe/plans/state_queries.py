"""Queries of sources and sinks and of the state of filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..sources import feeds, quarantine, stores
from .base import now, query
from .bind import view

TRANSIENT_STUDY = "parse_status = 'failed' and doc_type in ('study_dfs', 'study_pfs', 'study_scoping') and regexp_matches(coalesce(parse_error, ''), '(?i)RESOURCE_EXHAUSTED|429|timeout|503|overloaded')"


@query("select document_id, ticker, doc_type, announcement_date from filings where parse_status = 'parsed'")
def documents_filtered(s: SparkSession, d: str) -> DataFrame:
    return state.documents(view(s, d, "filings"), status="parsed").select("document_id", "ticker", "doc_type", "announcement_date")


@query("select document_id, sha256(upper(ticker) || ':' || url) as key from filings")
def content_key(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "filings").select("document_id", state.content_key(F.col("ticker"), F.col("url")).alias("key"))


@query("""with known as (select sha256(upper(ticker) || ':' || url) as key, parse_status, parse_error from filings), came as (select distinct sha256(upper(ticker) || ':' || case document_id % 3 when 0 then url || '?v2' when 1 then url else url || '?v' || document_id % 5 end) as key from filings)
    select coalesce(k.key, c.key) as key, case when k.key is null or (c.key is not null and parse_status in ('failed', 'skipped')) then 'pending' else parse_status end as parse_status, case when not (k.key is null or (c.key is not null and parse_status in ('failed', 'skipped'))) then parse_error end as parse_error,
        k.key is null or (c.key is not null and parse_status in ('failed', 'skipped')) as is_new from known k full join came c on c.key = k.key""")
def register_documents(s: SparkSession, d: str) -> DataFrame:
    f = view(s, d, "filings").select("document_id", "ticker", "url", "parse_status", "parse_error")
    existing = f.select(state.content_key(F.col("ticker"), F.col("url")).alias("key"), "parse_status", "parse_error")
    k = F.col("document_id")
    url = F.when(k % 3 == 0, F.concat("url", F.lit("?v2"))).when(k % 3 == 1, F.col("url")).otherwise(F.concat("url", F.lit("?v"), (k % 5).cast("string")))
    incoming = f.select(state.content_key(F.col("ticker"), url).alias("key"))
    return state.register_documents(existing, incoming.unionByName(incoming))


@query("""with c as (select ticker, timestamp '2024-01-01 00:00:00' + to_days(cast(company_id % 60 as int)) as first_seen_at, timestamp '2024-01-01 00:00:00' + to_days(cast(company_id % 60 as int)) as last_updated_at from companies), t as (select distinct case document_id % 5 when 0 then 'X' || document_id % 11 else ticker end as ticker from filings)
    select coalesce(c.ticker, t.ticker) as ticker, coalesce(first_seen_at, timestamp '2024-01-29 12:00:00') as first_seen_at, case when t.ticker is not null then greatest(coalesce(last_updated_at, timestamp '2024-01-29 12:00:00'), timestamp '2024-01-29 12:00:00') else last_updated_at end as last_updated_at from c full join t on t.ticker = c.ticker""")
def upsert_companies(s: SparkSession, d: str) -> DataFrame:
    seen = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=(F.col("company_id") % 60).cast("int"))
    c = view(s, d, "companies").select("ticker", seen.alias("first_seen_at"), seen.alias("last_updated_at"))
    k = F.col("document_id")
    t = view(s, d, "filings").select(F.when(k % 5 == 0, F.concat(F.lit("x"), (k % 11).cast("string"))).otherwise(F.col("ticker")).alias("ticker"))
    return state.upsert_companies(c, t, now())


@query("select p_partkey, 'upload://T1/' || p_name || '-v1_' || p_partkey || '.pdf' as url, replace(p_name, '-', ' ') || ' v1 ' || p_partkey as header from part")
def upload_key(s: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit("-v1_"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    url, header = state.upload_key(F.lit("T1"), name)
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", url.alias("url"), header.alias("header"))


@query("select document_id, case when doc_type in ('appendix_5b', 'issue_of_securities', 'resource_update', 'study_dfs', 'study_pfs', 'study_scoping') then 'direct' when doc_type = 'quarterly_activity' then 'scan' else 'ignore' end as route from filings")
def route_documents(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "filings").select("document_id", state.route(F.col("doc_type")).alias("route"))


@query("select document_id, timestamp '2024-01-29 12:00:00' + to_hours(cast(least(pow(2, retry_count), 24) as int)) as next_retry_at from filings")
def retry_backoff(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "filings").select("document_id", state.next_retry_at(F.col("retry_count"), now()).alias("next_retry_at"))


@query("select document_id, ticker from filings where parse_status = 'classified' or (parse_status = 'retry_scheduled' and due_in_hours <= 24)")
def due_documents(s: SparkSession, d: str) -> DataFrame:
    return state.select_extractable(view(s, d, "filings"), 24).select("document_id", "ticker")


@query(f"select document_id, case when {TRANSIENT_STUDY} then 'retry_scheduled' else parse_status end as parse_status, case when {TRANSIENT_STUDY} then 0 else retry_count end as retry_count, case when {TRANSIENT_STUDY} then 0 else due_in_hours end as due_in_hours, {TRANSIENT_STUDY} as requeued from filings")
def requeue_transient(s: SparkSession, d: str) -> DataFrame:
    return state.requeue_transient(view(s, d, "filings"))


@query("""select document_id, coalesce(case document_id % 4 when 0 then 'parsed' when 1 then 'failed' when 2 then 'skipped' end, parse_status) as parse_status, case document_id % 4 when 0 then null when 1 then 'read_error:' || document_id % 3 else parse_error end as parse_error from filings""")
def status_transition(s: SparkSession, d: str) -> DataFrame:
    f, k = view(s, d, "filings"), F.col("document_id")
    outcomes = f.select("document_id", F.when(k % 4 == 0, "parsed").when(k % 4 == 1, "failed").when(k % 4 == 2, "skipped").alias("outcome"), F.concat(F.lit("read_error:"), (k % 3).cast("string")).alias("error")).where("outcome is not null")
    return state.mark_status(f, outcomes)


AGAIN = "again as (select distinct f.document_id from company_financials f join filings d on d.document_id = f.document_id where d.doc_type in ('appendix_5b', 'quarterly_activity') and burn is not null)"


@query(f"with {AGAIN} select document_id, case when document_id in (select document_id from again) then 'classified' else parse_status end as parse_status, case when document_id not in (select document_id from again) then parse_error end as parse_error from filings")
def reset_reextract(s: SparkSession, d: str) -> DataFrame:
    return state.reset_for_reextract(view(s, d, "filings"), view(s, d, "company_financials"))[0]


@query(f"with {AGAIN} select financial_id from company_financials where document_id not in (select document_id from again)")
def reset_reextract_financials(s: SparkSession, d: str) -> DataFrame:
    return state.reset_for_reextract(view(s, d, "filings"), view(s, d, "company_financials"))[1].select("financial_id")


@query("select study_id from (select study_id, needs_review, case study_id % 4 when 0 then 'missing_pre_tax_npv; missing_tax_rate' when 1 then 'x; missing_post_tax_npv' when 2 then review_reason end as review_reason from studies) where needs_review and regexp_matches(review_reason, 'missing_(pre|post)_tax_npv')")
def reextract_candidates(s: SparkSession, d: str) -> DataFrame:
    k = F.col("study_id") % 4
    st = view(s, d, "studies").withColumn("review_reason", F.when(k == 0, "missing_pre_tax_npv; missing_tax_rate").when(k == 1, "x; missing_post_tax_npv").when(k == 2, F.col("review_reason")))
    return state.studies_to_reextract(st).select("study_id")


GEO = """select c_custkey as payload_id, concat('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"deposit_name":"', case c_custkey % 3 when 0 then '' else c_name end, '","DEPOSIT_NAME":"Alt ', cast(c_custkey as varchar(20)), '","', case c_custkey % 2 when 0 then 'holder_name' else 'OPERATOR' end, '":" Op ', cast(c_custkey % 50 as varchar(20)), ' Pty Ltd ","commodity":"Au, Cu;Ag","STATE":"WA","mining_status":null}},{"properties":{"name":"Second","commodities":"Ni/Co","operating_status":"Prospect"}}]}') as payload from customer"""


@query("""select case c_custkey % 3 when 0 then 'Alt ' || c_custkey else c_name end as deposit_name, 'Op ' || c_custkey % 50 || ' Pty Ltd' as operator_name, 'Au, Cu;Ag' as commodities, 'WA' as state, '' as operating_status from customer union all select 'Second', '', 'Ni/Co', '', 'Prospect' from customer""")
def deposits_geojson(s: SparkSession, d: str) -> DataFrame:
    return feeds.deposits_from_geojson(s.sql(GEO.replace("{", "{{").replace("}", "}}").replace("from customer", "from {customer}"), customer=s.read.parquet(f"{d}/customer.parquet")))


@query("select 'Mine ' || s_suppkey as deposit_name, case s_suppkey % 4 when 0 then '' else trim(s_name) end as operator_name, 'Gold' as commodities, '' as state, case s_suppkey % 2 when 0 then 'Operating Mine' else 'Care and maintenance' end as operating_status from supplier")
def deposits_csv(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    line = F.concat_ws(",", F.concat(F.lit("Mine "), k.cast("string")), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" "), "s_name")), F.lit("Gold"), F.when(k % 2 == 0, "Operating Mine").otherwise("Care and maintenance"))
    rows = s.read.parquet(f"{d}/supplier.parquet").select(F.from_csv(line, "`﻿PROJECT_NAME` string, Operator string, COMMODITY string, Status string").alias("r")).select("r.*")
    return feeds.deposits_from_records(rows)


@query("select 'T' || c_custkey as ticker from customer where c_custkey % 5 > 1")
def ticker_list(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lines = s.read.parquet(f"{d}/customer.parquet").select(F.when(k % 5 == 0, "# metals").when(k % 5 == 1, "  ").otherwise(F.concat(F.lit(" T"), k.cast("string"), F.lit(" "))).alias("value"))
    return feeds.tickers_of(lines)


def _charts(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    ts = [(F.lit(1704067200) + k * 3600 + i * 86400).cast("string") for i in range(3)]
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    body = F.concat(F.lit('{"chart":{"result":[{"meta":{"regularMarketPrice":'), F.when(k % 3 == 0, F.lit("null")).otherwise(cents), F.lit('},"timestamp":['), F.concat_ws(",", *ts), F.lit('],"indicators":{"quote":[{"close":['), cents, F.lit(","), F.when(k % 2 == 0, F.lit("null")).otherwise(F.lit("7.5")), F.lit(",12]}]}}]}}"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(k % 7 == 0, F.lit('{"chart":{"result":[]}}')).when(k % 11 == 0, F.lit('{"chart":{"result":null}}')).otherwise(body).alias("payload"))


CHARTED = "select event_id, round(value * 100) as cents, timestamp '2024-01-01 00:00:00' + to_hours(cast(event_id as int)) as t from events where event_id % 7 <> 0 and event_id % 11 <> 0"


@query(f"select event_id, cast(t as date) as date, cents as close from ({CHARTED}) union all select event_id, cast(t + interval 1 day as date), 7.5 from ({CHARTED}) where event_id % 2 = 1 union all select event_id, cast(t + interval 2 day as date), 12.0 from ({CHARTED})")
def price_series(s: SparkSession, d: str) -> DataFrame:
    return feeds.price_series(_charts(s, d), "event_id")


@query("select event_id, case when event_id % 7 <> 0 and event_id % 11 <> 0 and event_id % 3 <> 0 then round(value * 100) end as price, case when event_id % 7 = 0 or event_id % 11 = 0 then 'empty_result' when event_id % 3 = 0 then 'no_price' end as error from events")
def quote_rows(s: SparkSession, d: str) -> DataFrame:
    return feeds.latest_quotes(_charts(s, d), "event_id")


@query("select doc_id, 'Filing ' || doc_id as header, 'https://documents/k' || doc_id as url, '2001-02-03' as document_date from documents union all select doc_id, 'Second', 'https://documents/s' || doc_id, '2001-12-31' from documents")
def announcement_items(s: SparkSession, d: str) -> DataFrame:
    return feeds.announcement_items(_announced(s, d), "doc_id")


def _announced(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"data":{"items":[{"headline":"Filing '), k, F.lit('","documentKey":"k'), k, F.lit('","date":"2001-02-03T10:00:00Z"},{"headline":"Second","documentKey":"s'), k, F.lit('","date":"2001-12-31T23:59:59Z"}]}}'))
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", body.alias("payload"))


def _broken(payload: Column, k: Column, *cases: tuple[int, str, str]) -> Column:
    """payload with a pattern replaced where k % 10 is a case's number."""
    out = None
    for digit, pattern, new in cases:
        changed = F.regexp_replace(payload, pattern, new)
        out = F.when(k % 10 == digit, changed) if out is None else out.when(k % 10 == digit, changed)
    return out.otherwise(payload)


def _broken_news(s: SparkSession, d: str) -> DataFrame:
    cases = (3, r"\}$", ""), (4, r"\[.*\]", "[]"), (5, "2001-12-31", "some day"), (6, '"headline":"Filing [0-9]+"', '"headline":" "'), (7, r'"documentKey":"s\d+"', '"documentKey":null')
    return _announced(s, d).withColumn("payload", _broken(F.col("payload"), F.col("doc_id"), *cases))


@query("""select 'charts' as feed, case when event_id % 13 = 0 then 'not_json' when event_id % 7 = 0 or event_id % 11 = 0 then 'empty_result' when event_id % 17 = 0 then 'lengths_differ' else 'ok' end as reason,
        cast(sum(case when event_id % 13 > 0 and event_id % 7 > 0 and event_id % 11 > 0 and event_id % 17 > 0 then 2 + event_id % 2 else 1 end) as bigint) as n from events group by all
    union all select 'deposits', reason, count(*) from (select unnest(case c_custkey % 10 when 3 then ['not_json'] when 4 then ['no_features'] when 5 then ['ok', 'no_properties'] when 6 then ['ok', 'no_name'] else ['ok', 'ok'] end) as reason from customer) group by all
    union all select 'announcements', reason, count(*) from (select unnest(case doc_id % 10 when 3 then ['not_json'] when 4 then ['no_items'] when 5 then ['ok', 'bad_date'] when 6 then ['no_headline', 'ok'] when 7 then ['ok', 'no_key'] else ['ok', 'ok'] end) as reason from documents) group by all
    union all select 'registry', case s_suppkey % 10 when 3 then 'malformed' when 4 then 'malformed' when 5 then 'no_name' else 'ok' end, count(*) from supplier group by all""")
def feed_quarantine(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    charts = _charts(s, d).withColumn("payload", F.when(k % 13 == 0, F.substring("payload", 1, 15)).when(k % 17 == 0, F.regexp_replace("payload", r'"timestamp":\[\d+,', '"timestamp":[')).otherwise(F.col("payload")))
    geo = s.sql(GEO.replace("{", "{{").replace("}", "}}").replace("from customer", "from {customer}"), customer=s.read.parquet(f"{d}/customer.parquet"))
    geo = geo.withColumn("payload", _broken(F.col("payload"), F.col("payload_id"), (3, r"\]\}$", ""), (4, '"features":', '"feature":'), (5, r'\{"properties":\{"name":"Second".*\}\}\]', '{"properties":null}]'), (6, '"name":"Second"', '"name":" "')))
    j = F.col("s_suppkey")
    name = F.when(j % 10 == 5, "").otherwise(F.concat(F.lit("Mine "), j.cast("string")))
    line = F.when(j % 10 == 3, name).when(j % 10 == 4, F.concat_ws(",", name, F.lit("a,b,c,d,e"))).otherwise(F.concat_ws(",", name, F.lit("Op"), F.lit("Gold"), F.lit("PFS")))
    csv = F.from_csv(line, "PROJECT_NAME string, Operator string, COMMODITY string, Status string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    registry = s.read.parquet(f"{d}/supplier.parquet").select(csv.alias("r")).select("r.*")
    return (
        quarantine.tally("charts", quarantine.price_charts(charts, "event_id")).unionByName(quarantine.tally("deposits", quarantine.deposits_geojson(geo, "payload_id")))
        .unionByName(quarantine.tally("announcements", quarantine.announcements(_broken_news(s, d), "doc_id"))).unionByName(quarantine.tally("registry", quarantine.deposit_records(registry)))
    )


@query("""select doc_id, place, reason from (select doc_id, unnest(case doc_id % 10 when 3 then [{'place': null, 'reason': 'not_json'}] when 4 then [{'place': null, 'reason': 'no_items'}] when 5 then [{'place': 1, 'reason': 'bad_date'}] when 6 then [{'place': 0, 'reason': 'no_headline'}] when 7 then [{'place': 1, 'reason': 'no_key'}] else [] end, recursive := true) from documents)""")
def announcement_rejects(s: SparkSession, d: str) -> DataFrame:
    return quarantine.announcements(_broken_news(s, d), "doc_id").rejects.select("doc_id", "place", "reason")


@query("select document_id, doc_type, financial_id from (select *, row_number() over (partition by document_id, doc_type order by effective_date desc, financial_id desc) as r from company_financials) where r = 1")
def staging_latest(s: SparkSession, d: str) -> DataFrame:
    return stores.latest_staging(view(s, d, "company_financials"), ["document_id", "doc_type"], [F.desc("effective_date"), F.desc("financial_id")]).select("document_id", "doc_type", "financial_id")


@query("select document_id from filings where document_id not in (select document_id from company_financials)")
def snapshots_new_only(s: SparkSession, d: str) -> DataFrame:
    return stores.new_snapshots(view(s, d, "filings").select("document_id"), view(s, d, "company_financials"))
