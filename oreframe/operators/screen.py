"""The ranked screener: one row per company, built of projects, studies, commodities and revaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, valuation
from .common import top

LOW_BASE_NPV, STALE_YEARS, RECENT_SINCE = 50.0, 3.0, "2024-01-01"
SORTS = ("most_advanced_stage_desc", "project_count", "ticker", "uplift_abs_desc", "uplift_pct_desc")


def active_projects(projects: DataFrame, studies: DataFrame, resources: DataFrame) -> DataFrame:
    """Projects with a study, or with a resource and a name that isn't junk, and whether they have a study. One aggregate and one join."""
    seen = studies.select("project_id", F.lit(True).alias("s")).union(resources.select("project_id", F.lit(False).alias("s"))).groupBy("project_id").agg(F.bool_or("s").alias("has_study"))
    return projects.join(seen, "project_id").where(F.col("has_study") | ~text.is_junk_name(F.col("project_name")))


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "definitive", 0).when(tier == "indicative", 1).otherwise(2)


def latest_study(studies: DataFrame, key: str = "project_id") -> DataFrame:
    """The newest study of each key by its date, or else its announcement's; ties by the stored tier, then id. Adds tier (the stored one) and date."""
    d = studies.withColumns({"tier": F.col("study_confidence_tier"), "date": F.coalesce("study_date", "announcement_date")})
    return top(d, [key], [F.desc_nulls_last("date"), tier_rank(F.col("tier")), F.desc("study_id")])


def company_latest_study(studies: DataFrame) -> DataFrame:
    """Stage and date of one study: the newest among the newest of each project."""
    return top(latest_study(studies), ["company_id"], [F.desc_nulls_last("date"), tier_rank(F.col("tier")), F.desc("study_id")])


def _names(column: str) -> Column:
    return F.array_sort(F.collect_set(column))


def company_rollup(companies: DataFrame, projects: DataFrame, studies: DataFrame, active: DataFrame) -> DataFrame:
    """Counts, places, stages and studies of companies with an active project."""
    total = projects.groupBy("company_id").agg(F.count("*").alias("n_projects"))
    live = active.groupBy("company_id").agg(
        F.count("*").alias("n_active"), _names("stage").alias("stages"), _names("country").alias("countries"), _names("state").alias("states"), _names("region").alias("regions"),
        F.min(valuation.stage_rank(F.col("stage"))).alias("rank"),
    )
    st = studies.groupBy("company_id").agg(F.countDistinct("project_id").alias("n_with_study"), F.bool_or(valuation.revaluable(F.col("study_confidence_tier"))).alias("has_dfs_pfs"))
    newest = company_latest_study(studies).select("company_id", F.col("study_stage").alias("latest_study_stage"), F.col("date").alias("latest_study_date"))
    stages = F.array(*[F.lit(s) for s in valuation.STAGES])
    d = companies.join(live, "company_id").join(total, "company_id", "left").join(st, "company_id", "left").join(newest, "company_id", "left")
    return d.withColumns({"most_advanced": F.get(stages, F.col("rank").cast("int") - 1), "n_with_study": F.coalesce("n_with_study", F.lit(0)), "has_dfs_pfs": F.coalesce("has_dfs_pfs", F.lit(False))})


def primary_commodities(active: DataFrame, project_commodities: DataFrame) -> DataFrame:
    own = project_commodities.where("is_primary").join(active.select("project_id", "company_id"), "project_id")
    return own.groupBy("company_id").agg(_names("commodity").alias("commodities"))


def company_revaluation(revals: DataFrame, studies: DataFrame, key: str = "company_id") -> DataFrame:
    """The revaluation that stands for each key: of studies stored as definitive or indicative first, then the newest study, then the newest run."""
    s = studies.select("study_id", "study_stage", F.col("study_confidence_tier").alias("_tier"), "study_date", "reporting_currency", "needs_review", "review_reason")
    d = revals.join(s, "study_id", "left")
    eligible = F.when(valuation.revaluable(F.col("_tier")), 0).otherwise(1)
    return top(d, [key], [eligible, F.desc_nulls_last("study_date"), F.desc("computed_at"), F.desc("revaluation_id")]).drop("_tier")


def coverage_of(warnings: Column) -> Column:
    """The coverage that a JSON list of warnings tells; 100 without."""
    found = F.get(F.filter(F.from_json(warnings, "array<string>"), lambda w: w.startswith("coverage_pct:")), F.lit(0))
    return F.coalesce(F.split(found, ":").getItem(1).try_cast("double"), F.lit(100.0))


def signal_flags(revaluation: DataFrame, as_of: Column) -> DataFrame:
    """What weakens a revaluation as a signal."""
    age = F.bround(F.datediff(as_of, F.col("study_date")) / 365.25, 1)
    doubts = F.when(F.col("needs_review"), F.nullif(text.npv_reasons(F.col("review_reason")), F.lit("")))
    d = revaluation.withColumns({"coverage_pct": coverage_of(F.col("warnings")), "study_age_years": age, "review_doubts": doubts})
    return d.withColumns({
        "is_partial_basket": F.col("coverage_pct") < 100, "is_stale_study": F.coalesce(F.col("study_age_years") > STALE_YEARS, F.lit(False)), "deck_far_below_spot": F.coalesce(F.col("price_dfs") < F.col("price_spot") / 2, F.lit(False)),
        "low_base": F.coalesce(F.col("npv_dfs") < LOW_BASE_NPV, F.lit(False)), "study_needs_review": F.col("review_doubts").isNotNull(),
    })


def screen(rollup: DataFrame, commodities: DataFrame, flagged: DataFrame) -> DataFrame:
    """The screener's table: flagged has one revaluation for each company at most."""
    own = flagged.select("company_id", "npv_uplift", "npv_uplift_pct", "coverage_pct", "low_base", "is_stale_study")
    return rollup.join(commodities, "company_id", "left").join(own, "company_id", "left").withColumn("commodities", F.coalesce("commodities", F.array().cast("array<string>")))


def screen_filter(
    screen: DataFrame, single_project: bool = False, stage: str | None = None, commodity: str | None = None, country: str | None = None, recent_since: str | None = None, study_after: str | None = None, supported_only: bool = False
) -> DataFrame:
    """The companies that pass all filters given; stage is the most advanced one exactly."""
    if single_project:
        screen = screen.where("n_active = 1")
    if stage in valuation.STAGES:
        screen = screen.where(F.col("most_advanced") == stage)
    if commodity:
        screen = screen.where(F.array_contains("commodities", commodity))
    if country:
        screen = screen.where(F.array_contains("countries", country))
    for since in (recent_since, study_after):
        if since:
            screen = screen.where(F.col("latest_study_date") >= F.lit(since).cast("date"))
    if supported_only:
        screen = screen.where(F.col("has_dfs_pfs") & F.arrays_overlap("commodities", F.array(*[F.lit(m) for m in valuation.SUPPORTED])))
    return screen


def screen_search(companies: DataFrame, words: str, limit: int = 8) -> DataFrame:
    """Companies whose ticker or name holds the words, tickers that begin with them first."""
    q = words.strip().lower()
    hit = F.lower("ticker").contains(q) | F.coalesce(F.lower("company_name").contains(q), F.lit(False))
    return companies.where(hit).orderBy(F.desc(F.lower("ticker").startswith(q)), "ticker").limit(limit)


def visible(screen: DataFrame, words: str = "", hide_empty: bool = False) -> DataFrame:
    """The screener's list as shown: without companies that have no study, if asked, and with words in ticker or name."""
    q = words.strip().lower()
    shown = screen.where("n_with_study > 0") if hide_empty else screen
    return shown.where(F.lower("ticker").contains(q) | F.coalesce(F.lower("company_name").contains(q), F.lit(False))) if q else shown


def rank_screen(screen: DataFrame, sort: str = "most_advanced_stage_desc", limit: int = 200) -> DataFrame:
    """The first `limit` (500 at most) in the order of sort, companies without the value last, ties by ticker."""
    order = {
        "most_advanced_stage_desc": F.coalesce(F.col("rank"), F.lit(99)), "project_count": F.desc("n_active"), "ticker": F.col("ticker"), "uplift_abs_desc": F.desc_nulls_last("npv_uplift"), "uplift_pct_desc": F.desc_nulls_last("npv_uplift_pct"),
    }[sort]
    return screen.orderBy(order, "ticker").limit(min(limit, 500))


def rank_screens(screen: DataFrame, limit: int = 200) -> DataFrame:
    """The first `limit` in every order at once (sort, place, ...): one pass over the screen, of which each task keeps `limit` rows an order."""
    keys = {
        "most_advanced_stage_desc": F.coalesce(F.col("rank"), F.lit(99)), "project_count": -F.col("n_active"), "ticker": F.lit(0), "uplift_abs_desc": -F.col("npv_uplift"), "uplift_pct_desc": -F.col("npv_uplift_pct"),
    }
    d = screen.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(n).alias("sort"), k.cast("double").alias("key")) for n, k in keys.items()]))).withColumns({"sort": F.col("_s.sort"), "_key": F.col("_s.key")})
    place = F.row_number().over(W.partitionBy("sort").orderBy(F.asc_nulls_last("_key"), "ticker"))
    return d.withColumn("place", place).where(F.col("place") <= min(limit, 500)).drop("_s", "_key")


def screen_facets(screen: DataFrame) -> DataFrame:
    one = lambda facet, column: screen.select(F.lit(facet).alias("facet"), F.explode(column).alias("value"))
    return one("country", "countries").unionByName(one("commodity", "commodities")).groupBy("facet", "value").agg(F.count("*").alias("n"))


FACETS = {"country": "countries", "state": "states", "region": "regions", "commodity": "commodities", "stage": None}


def facets_under_filter(screen: DataFrame, chosen: dict[str, str], facets: tuple[str, ...] = tuple(FACETS)) -> DataFrame:
    """(facet, value, n): companies with each value of each facet that pass the choices made in all other facets, so that a choice doesn't hide its alternatives.

    One pass: a company is counted for a facet if nothing but this facet's own choice excludes it. Filters that
    are no facets belong before (screen_filter).
    """
    of = {f: F.array(F.col("most_advanced")) if c is None else F.col(c) for f, c in FACETS.items()}
    fails = {f: ~F.coalesce(F.array_contains(of[f], value), F.lit(False)) for f, value in chosen.items()}
    n_fails = sum((x.cast("int") for x in fails.values()), F.lit(0))
    counted = []
    for f in facets:
        others = n_fails - fails[f].cast("int") if f in fails else n_fails
        values = F.array_distinct(F.array_compact(of[f]))
        counted.append(F.when(others == 0, F.struct(F.lit(f).alias("facet"), values.alias("values"))))
    one = screen.select(F.inline(F.array_compact(F.array(*counted)))).select("facet", F.explode("values").alias("value"))
    return one.groupBy("facet", "value").agg(F.count("*").alias("n"))


def stage_breakdown(active: DataFrame) -> DataFrame:
    """Projects of each stage, by company."""
    return active.where("stage is not null").groupBy("company_id", "stage").agg(F.count("*").alias("n"))


def project_detail(projects: DataFrame, studies: DataFrame, resources: DataFrame, project_commodities: DataFrame, revals: DataFrame, companies: DataFrame, filings: DataFrame, inferences: DataFrame, as_of: Column) -> DataFrame:
    """A row for each project that may be shown, with its newest study, resource and revaluation, its metals and its counts."""
    s = studies.groupBy("project_id").agg(F.count("*").alias("n_studies"))
    r = resources.groupBy("project_id").agg(F.count("*").alias("n_resources"), F.max_by(F.struct("resource_id", "commodity", "category"), F.struct("effective_date", "resource_id")).alias("latest_resource"))
    c = project_commodities.groupBy("project_id").agg(F.min(F.when(F.col("is_primary"), F.col("commodity"))).alias("primary_commodity"), _names("commodity").alias("all_commodities"))
    both = project_commodities.select("project_id", "commodity").union(resources.select("project_id", "commodity")).where("commodity is not null").distinct().groupBy("project_id").agg((F.count("*") > 1).alias("is_multi_commodity"))
    newest = top(studies, ["project_id"], [F.desc_nulls_last("study_date"), F.desc("study_id")]).select("project_id", F.col("study_id").alias("latest_study_id"), F.col("study_stage").alias("latest_study_stage"))
    v = signal_flags(company_revaluation(revals, studies, "project_id"), as_of).select("project_id", "revaluation_id", "npv_spot", "study_age_years", "is_stale_study", "low_base")
    n = filings.groupBy("ticker").agg(F.count("*").alias("n_documents"))
    i = inferences.groupBy("project_id").agg(F.max_by("stage_confidence", "inferred_at").alias("confidence"))
    p = projects.join(companies.select("company_id", "ticker"), "company_id")
    for part in (s, r, c, both, newest, v, i):
        p = p.join(part, "project_id", "left")
    p = p.join(n, "ticker", "left").withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_studies", "n_resources", "n_documents")})
    p = p.withColumns({"is_active": (F.col("n_studies") > 0) | (F.col("n_resources") > 0), "is_multi_commodity": F.coalesce("is_multi_commodity", F.lit(False)), "stage_confidence": F.when(F.col("stage_source") == "inferred", F.col("confidence"))}).drop("confidence")
    return p.where(~text.is_junk_name(F.col("project_name")) | (F.col("n_studies") > 0))


def age_bucket(age: Column) -> Column:
    return F.when(age <= 1.5, "fresh").when(age <= 3, "ageing").when(age > 3, "stale")


def vintage(age: Column) -> Column:
    """Of a study's economics; none for future dates."""
    return F.when(age < 0, None).when(age < 3, "fresh").when(age < 5, "aging").when(age >= 5, "stale")
