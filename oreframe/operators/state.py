"""The state of filings: registration, routing, retries and resets. Every operator gives the next state as rows; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Types that are read directly, and types that are searched for an embedded form.
TARGET_TYPES = ("appendix_5b", "issue_of_securities", "resource_update", "study_dfs", "study_pfs", "study_scoping")
SCAN_TYPES = ("quarterly_activity",)
STUDY_TYPES = ("study_dfs", "study_pfs", "study_scoping")


def content_key(ticker: Column, url: Column) -> Column:
    """The key that a filing is known by: sha256 of TICKER:url."""
    return F.sha2(F.concat_ws(":", F.upper(F.trim(ticker)), url), 256)


def register_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Filings after a poll: key, parse_status, parse_error, is_new.

    existing has key, parse_status and parse_error, incoming has key, repeats
    allowed. New ones are pending; failed and skipped ones that come again are
    pending too and count as new; the rest stay as they are.
    """
    seen = incoming.select("key").distinct().withColumn("came", F.lit(True))
    again = F.col("came") & F.coalesce(F.col("parse_status").isin("failed", "skipped"), F.lit(False))
    is_new = F.coalesce(F.col("known").isNull() | again, F.lit(False))
    both = existing.select("key", "parse_status", "parse_error").withColumn("known", F.lit(True)).join(seen, "key", "full")
    return both.select("key", F.when(is_new, "pending").otherwise(F.col("parse_status")).alias("parse_status"), F.when(~is_new, F.col("parse_error")).alias("parse_error"), is_new.alias("is_new"))


def upsert_companies(existing: DataFrame, tickers: DataFrame, now: Column) -> DataFrame:
    """Companies with those of tickers added or touched: ticker, first_seen_at, last_updated_at."""
    seen = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).distinct().withColumn("came", F.lit(True))
    both = existing.select("ticker", "first_seen_at", "last_updated_at").join(seen, "ticker", "full")
    return both.select("ticker", F.coalesce("first_seen_at", now).alias("first_seen_at"), F.when(F.col("came"), F.greatest(F.coalesce("last_updated_at", now), now)).otherwise(F.col("last_updated_at")).alias("last_updated_at"))


def upload_key(ticker: Column, filename: Column) -> tuple[Column, Column]:
    """(url, header) of an uploaded file."""
    return F.concat(F.lit("upload://"), ticker, F.lit("/"), filename), F.regexp_replace(F.regexp_replace(filename, r"\.pdf", ""), "[-_]", " ")


def route(doc_type: Column) -> Column:
    return F.when(doc_type.isin(*TARGET_TYPES), "direct").when(doc_type.isin(*SCAN_TYPES), "scan").otherwise("ignore")


def next_retry_at(retry_count: Column, now: Column) -> Column:
    return now + F.make_dt_interval(hours=t.retry_wait_hours(retry_count))


def documents(filings: DataFrame, status: str | None = None, doc_type: str | None = None, ticker: str | None = None) -> DataFrame:
    """Filings by optional filters, newest first within each ticker."""
    for column, wanted in (("parse_status", status), ("doc_type", doc_type), ("ticker", ticker)):
        filings = filings if wanted is None else filings.where(F.col(column) == wanted)
    return filings.orderBy("ticker", F.desc_nulls_last("announcement_date"), F.desc("document_id"))


def select_extractable(filings: DataFrame, now_hours: int) -> DataFrame:
    """Classified filings and retries that are due, newest first."""
    due = (F.col("parse_status") == "classified") | ((F.col("parse_status") == "retry_scheduled") & (F.col("due_in_hours") <= now_hours))
    return filings.where(due).orderBy(F.desc_nulls_last("announcement_date"), F.desc("document_id"))


def requeue_transient(filings: DataFrame) -> DataFrame:
    """All filings, with failed studies whose error passes scheduled again from the start."""
    error = F.coalesce("parse_error", F.lit(""))
    again = (F.col("parse_status") == "failed") & F.col("doc_type").isin(*STUDY_TYPES) & error.rlike("(?i)RESOURCE_EXHAUSTED|429|timeout|503|overloaded")
    return filings.select(
        "document_id", F.when(again, "retry_scheduled").otherwise(F.col("parse_status")).alias("parse_status"), F.when(again, 0).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(again, 0).otherwise(F.col("due_in_hours")).alias("due_in_hours"), again.alias("requeued"),
    )


def mark_status(filings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Filings after outcomes(document_id, outcome, error): parsed clears an old error, failed takes the new one, skipped keeps what is there."""
    o, status = F.col("outcome"), F.col("parse_status")
    return filings.join(outcomes, "document_id", "left").select(
        "document_id", F.coalesce(o, status).alias("parse_status"), F.when(o == "parsed", None).when(o == "failed", F.col("error")).otherwise(F.col("parse_error")).alias("parse_error"),
    )


def _burning(filings: DataFrame, financials: DataFrame) -> DataFrame:
    forms = filings.where(F.col("doc_type").isin("appendix_5b", "quarterly_activity")).select("document_id")
    return financials.where("burn is not null").join(forms, "document_id", "left_semi").select("document_id").distinct()


def reset_for_reextract(filings: DataFrame, financials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filings, financials) with forms that gave a burn back to classified, and their rows gone."""
    again = _burning(filings, financials)
    marked = filings.join(again.withColumn("again", F.lit(True)), "document_id", "left")
    docs = marked.select("document_id", F.when(F.col("again"), "classified").otherwise(F.col("parse_status")).alias("parse_status"), F.when(F.col("again").isNull(), F.col("parse_error")).alias("parse_error"))
    return docs, financials.join(again, "document_id", "left_anti")


def studies_to_reextract(studies: DataFrame) -> DataFrame:
    return studies.where(F.col("needs_review") & F.col("review_reason").rlike("missing_pre_tax_npv|missing_post_tax_npv"))
