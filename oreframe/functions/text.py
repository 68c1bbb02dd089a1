"""Classification and parsing of filing text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first type with a phrase in the headline wins.
HEADLINE_TYPES = [
    ("appendix_5b", ["appendix 5b", "quarterly cash flow", "quarterly cashflow"]),
    ("study_dfs", [
        "definitive feasibility", "dfs results", "dfs outcomes", "dfs confirms", "dfs delivers", "dfs update", "dfs completion", "dfs completed", "updated dfs", "revised dfs", "optimised dfs",
        "final feasibility study", "ffs results", "bankable feasibility study", "bfs results", "feasibility update", "dfs",
    ]),
    ("study_pfs", ["pre-feasibility", "pfs"]),
    ("study_scoping", ["scoping study", "preliminary economic assessment"]),
    ("issue_of_securities", [
        "appendix 3g", "appendix 3b", "appendix 2a", "notification of issue", "issue, conversion or payment", "conversion of securities", "exercise of options", "vesting of performance rights",
        "application for quotation of securities", "statement of cdis", "cdis on issue", "cessation of securities",
    ]),
    ("placement", ["placement", "entitlement offer", "rights issue", "capital raising", "share purchase plan", "spp"]),
    ("resource_update", ["resource estimate", "reserve estimate", "jorc resource", "mineral resource", "ore reserve", "resource update", "maiden resource"]),
    ("half_year_report", ["half year", "half-year", "interim financial", "6 month"]),
    ("annual_report", ["annual report", "annual financial"]),
    ("quarterly_activity", [
        "quarterly activity", "quarterly report", "operations update", "quarterly activities", "quarterly production", "quarterly update", "quarter update", "quarter report", "quarter financials",
        "march quarter", "june quarter", "september quarter", "december quarter", "first quarter", "second quarter", "third quarter", "fourth quarter", "q1 ", "q2 ", "q3 ", "q4 ", "investment update",
    ]),
    ("presentation", ["investor presentation", "corporate presentation", "investor update", "corporate update", "presentation"]),
]
# The same for a first page.
FIRST_PAGE_TYPES = [
    ("appendix_5b", ["appendix 5b", "mining exploration entity", "quarterly cash flow report"]),
    ("issue_of_securities", ["notification of issue", "appendix 3g", "securities issued or to be issued"]),
    ("annual_report", ["annual report", "directors' report"]),
    ("half_year_report", ["half year financial", "interim financial report"]),
]
# First words of prose that isn't a name, and words that no name has.
PROSE_STARTS = ("the", "its", "it", "all", "this", "that", "both", "o", "details", "relates", "release", "continues", "strike", "additional", "last", "upper", "further")
PROSE_WORDS = ("has", "was", "were", "will", "expected", "confirms", "demonstrates", "intended", "completed", "announced", "updated", "delivers", "supports", "used", "show", "unlock", "emerge")
# Marks of errors that pass, retries, and cells without a number.
TRANSIENT = ("429", "resource_exhausted", "503", "overloaded", "500", "timeout", "deadline", "connection", "network", "download_failed", "temporarily")
MAX_RETRIES, LONGEST_WAIT_HOURS = 5, 24
NIL = ("", "-", "–", "—", "N/A", "n/a", "nil", "Nil")


def _first_type(low: Column, types: list[tuple[str, list[str]]]) -> Column:
    out = None
    for name, phrases in types:
        hit = low.rlike("|".join(phrases))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def headline_type(header: Column) -> Column:
    """The type that a headline names, or null; a feasibility study that is neither pre-feasibility nor scoping is a definitive one."""
    low = F.regexp_replace(F.lower(header), r"^\s+|\s+$", "")
    generic = header.rlike(r"(?i)(?<!pre[- ])(?<!pre)feasibility\s+study") & ~low.contains("scoping")
    return _first_type(low, HEADLINE_TYPES).when(generic, "study_dfs")


def first_page_type(page: Column) -> Column:
    return _first_type(F.lower(page), FIRST_PAGE_TYPES)


def header_tier(header: Column) -> Column:
    return (
        F.when(header.rlike(r"(?i)\b(scoping|pea)\b"), "conceptual")
        .when(header.rlike(r"(?i)\b(pre[-\s]?feasibility|prefeasibility|pfs)\b"), "indicative")
        .when(header.rlike(r"(?i)\b(definitive\s+feasibility|dfs|bfs|bankable\s+feasibility|feasibility\s+study)\b"), "definitive")
    )


def failure_class(error: Column) -> Column:
    return F.when(F.lower(F.coalesce(error, F.lit(""))).rlike("|".join(TRANSIENT)), "transient").otherwise("permanent")


def retry_wait_hours(retry_count: Column) -> Column:
    return F.least(F.pow(F.lit(2), retry_count), F.lit(LONGEST_WAIT_HOURS)).cast("int")


_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_amount(s: Column) -> Column:
    """A table cell as a number: commas out, negative within parentheses; nil words and anything else are null."""
    t = F.trim(s)
    within = t.rlike(r"(?s)^\(.*\)$")
    digits = F.trim(F.regexp_replace(F.when(within, F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t), ",", ""))
    number = F.when(digits.rlike(_PLAIN), digits.try_cast("double"))
    return F.when(t.isin(*NIL), None).when(within, -number).otherwise(number)


def scaled_amount(s: Column) -> Column:
    """'A$12.5M', '~3 billion' and the like as a number, else null."""
    t = F.trim(F.regexp_replace(F.ltrim(F.regexp_replace(F.trim(s), "^~+", "")), r"^[A-Z]{0,3}\$", ""))
    unit = F.lower(F.regexp_extract(t, r"(?i)(billion|million|b|m|k)$", 1))
    digits = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)(billion|million|b|m|k)$", ""), ",", ""))
    n = F.when(digits.rlike(_PLAIN), digits.try_cast("double"))
    return n * F.when(unit.isin("billion", "b"), 1e9).when(unit.isin("million", "m"), 1e6).when(unit == "k", 1e3).otherwise(1.0)


def tonnes_to_mt(v: Column, unit: Column) -> Column:
    return F.when(unit == "kt", v / 1e3).when(unit == "t", v / 1e6).otherwise(v)


def is_prose_name(name: Column) -> Column:
    """Whether a captured name is a fragment of prose: long, of many words, in lower case, or with words that no name has."""
    words = F.split(F.trim(name), r"\s+")
    low = F.transform(words, lambda w: F.lower(w))
    return (F.length(name) > 40) | (F.size(words) > 5) | name.rlike("^[a-z]") | F.get(low, F.lit(0)).isin(*PROSE_STARTS) | F.arrays_overlap(low, F.array(*[F.lit(w) for w in PROSE_WORDS]))


def is_junk_name(name: Column) -> Column:
    """The screener's rule: long names, and those that begin in lower case or like prose."""
    return (F.length(name) > 40) | name.rlike("^[a-z]") | F.lower(name).rlike("^(" + "|".join(PROSE_STARTS) + ") ")


def npv_reasons(reason: Column) -> Column:
    """Of ;-separated review reasons those that doubt the NPV."""
    parts = F.transform(F.split(F.coalesce(reason, F.lit("")), ";"), lambda x: F.trim(x))
    return F.array_join(F.filter(parts, lambda r: r.rlike("npv_ge_pre|implied_tax_gap|npv_post")), "; ")


def error_bucket(error: Column) -> Column:
    """The head of an error, with the next segment where the head says nothing by itself."""
    part = F.split(F.coalesce(F.nullif(error, F.lit("")), F.lit("none")), "[:(]")
    head, inner = F.substring(F.trim(F.get(part, 0)), 1, 60), F.substring(F.trim(F.get(part, 1)), 1, 40)
    return F.when(head.isin("study_parse_error", "llm_api_error") & (inner != ""), F.concat_ws(":", head, inner)).otherwise(head)
