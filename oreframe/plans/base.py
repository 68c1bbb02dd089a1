"""Registration of queries with their SQL, and fragments that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bind import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
# SQL fragments used by several oracles.
TIER = "case when study_stage in ('DFS', 'Updated DFS', 'Revised DFS', 'FFS') then 'definitive' when study_stage in ('PFS', 'Updated PFS') then 'indicative' else 'conceptual' end"
#: The gate's and the refresh's tier: the stored one, or that of the stage.
EFFECTIVE = f"coalesce(study_confidence_tier, {TIER})"
REVALUABLE = "coalesce(study_confidence_tier in ('definitive', 'indicative'), false)"
BAD = "case when commodity in ('Au', 'Pd', 'Pt') and annual_production > 1000000 then lower(commodity) || '_production_implausible_check_lom' when commodity = 'Ag' and annual_production >= 100 and annual_production < 1000 then 'ag_production_unit_ambiguous' when commodity = 'U3O8' and annual_production >= 20 and annual_production < 100000 then 'u3o8_production_unit_ambiguous' when commodity = 'U3O8' and annual_production > 30000000 then 'u3o8_production_implausible' end"
FACTOR = "case when commodity in ('Au', 'Pd', 'Pt') and annual_production < 1000 then 1000 when commodity = 'Ag' and annual_production < 100 then 1000000 when commodity = 'U3O8' and annual_production < 20 then 1000000 when commodity = 'Cu' and annual_production < 100 then 1000 else 1 end"
TAX = "case when tax_rate_pct > 0 and tax_rate_pct < 1 then round_even(tax_rate_pct * 100, 1) else tax_rate_pct end"
JUNK = "(length(project_name) > 40 or regexp_matches(project_name, '^[a-z]') or regexp_matches(lower(project_name), '^(the|its|it|all|this|that|both|o|details|relates|release|continues|strike|additional|last|upper|further) '))"
STAGE_RANK = "case stage when 'production' then 1 when 'care_and_maintenance' then 2 when 'development' then 3 when 'feasibility' then 4 when 'advanced_exploration' then 5 when 'exploration' then 6 else 7 end"
TRANSIENT = "regexp_matches(lower(coalesce(parse_error, '')), '429|resource_exhausted|503|overloaded|500|timeout|deadline|connection|network|download_failed|temporarily')"


def day(text: str = "2001-09-01") -> Column:
    return F.lit(text).cast("date")


def now() -> Column:
    return F.lit("2024-01-29 12:00:00").cast("timestamp")


def rounded(x: Column | str, n: int) -> Column:
    """x to n places as SQL's round does it on doubles: x * 10^n to the nearest whole number, halves away from zero, and back. F.round goes by x's decimal digits, which differs where only these end in a 5."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 10.0**n, 0) / 10.0**n


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        name = f.__name__
        QUERIES[name] = f
        ORACLE_SQL[name] = with_views(sql)
        return f

    return add
