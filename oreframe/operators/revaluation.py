"""Studies revalued at spot, metal by metal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import valuation as v
from .common import top

FX = "AUDUSD"
STALE_YEARS = 3
#: Reasons that lie in what a study is or lacks: its tier, fields, currency or metals.
UNFIT = "^(not_revaluable|missing_fields|reporting_currency|no_study)"


def _quotes(prices: DataFrame) -> Column:
    """commodity -> (price_usd, price_id) as one value for all rows: prices has a row for each commodity."""
    return prices.agg(F.map_from_entries(F.collect_list(F.struct("commodity", F.struct("price_usd", "price_id"))))).scalar()


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def with_legs(studies: DataFrame, legs: DataFrame) -> DataFrame:
    """studies with raw_legs: their legs in leg order, each with price and unit of the first entry for its metal in the study's deck. Null without legs. legs has a row for each study and metal.

    One narrow aggregate and one join by study_id.
    """
    own = legs.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct("leg", "commodity", "annual_production", "is_primary"))).alias("_legs"))
    entry = lambda deck, x: F.get(F.filter(deck, lambda e: e["commodity"] == x["commodity"]), F.lit(0))
    one = lambda x, e: F.struct(*[x[c].alias(c) for c in ("leg", "commodity", "annual_production", "is_primary")], e["price"].alias("price"), e["unit"].alias("unit"))
    raw = _let(F.from_json("assumed_price_deck", v.DECK), lambda deck: F.transform("_legs", lambda x: _let(entry(deck, x), lambda e: one(x, e))))
    return studies.join(own, "study_id", "left").withColumn("raw_legs", raw).drop("_legs")


def resolved_legs(studies: DataFrame, prices: DataFrame) -> DataFrame:
    """resolve_legs of studies that have their raw_legs, without a join."""
    metal, made, price, unit, spot = F.col("commodity"), F.col("annual_production"), F.col("price"), F.col("unit"), F.col("quote.price_usd")
    d = studies.select("study_id", F.inline("raw_legs")).withColumn("_quotes", _quotes(prices))
    quoted = lambda key: F.try_element_at("_quotes", key)
    d = d.withColumns({"quote": quoted(metal), "fx": quoted(F.lit(FX))["price_usd"], "known": F.coalesce(metal.isin(*v.SUPPORTED), F.lit(False))})
    d = d.withColumns({"aud": v.is_aud_unit(unit) & price.isNotNull(), "refused": F.when(F.col("known"), v.production_error(metal, made))})
    usd = F.when(metal == "Cu", v.copper_per_pound(price, unit)).otherwise(price)
    d = d.withColumns({"deck": F.when(F.col("aud"), usd * F.col("fx")).otherwise(usd), "production": F.when(~F.col("known"), made).when(F.col("refused").isNull(), made * v.production_factor(metal, made))})
    d = d.withColumn("supported", F.col("known") & F.col("deck").isNotNull() & F.col("production").isNotNull())
    supported, deck = F.col("supported"), F.col("deck")
    basis = F.when(supported, v.to_price_basis(F.col("production"), metal, v.basis_unit(metal))).otherwise(F.col("production"))
    return d.select(
        "study_id", "leg", "commodity", "is_primary", "supported", "deck", "production", v.basis_unit(metal).alias("production_unit"),
        F.when(supported, spot).alias("spot_price"), F.when(supported, F.col("quote.price_id")).alias("spot_id"),
        F.when(supported, basis * (spot - deck)).otherwise(0.0).alias("delta_revenue"), F.coalesce(basis * deck, F.lit(0.0)).alias("deck_revenue"),
        F.when(F.col("aud") & F.col("fx").isNull(), "fx_missing:AUDUSD").when(F.col("refused").isNotNull(), F.col("refused"))
        .when(supported & spot.isNull(), F.concat(F.lit("spot_missing:"), metal)).alias("leg_error"),
        F.array_compact(F.array(
            F.when((metal == "Cu") & price.isNotNull(), v.copper_warning(price, unit)), F.when(F.col("aud"), F.concat(F.lit("price_deck_aud_to_usd_"), metal, F.lit(":"), unit)),
            F.when(F.col("known"), v.production_warning(metal, made)),
        )).alias("leg_warnings"),
        F.when(supported & (deck < spot / 2), F.concat(F.lit("deck_far_below_spot_"), metal, F.lit(":"), v.number(deck), F.lit("_vs_"), v.number(spot))).alias("far"),
    )


def resolve_legs(studies: DataFrame, legs: DataFrame, prices: DataFrame) -> DataFrame:
    """Legs of known studies with deck price, production in the price's unit, spot price and revenue, a row each.

    prices' AUDUSD row (US dollars per Australian dollar) converts decks in Australian
    dollars. leg_error is why the study must be refused: no exchange rate, a production
    that can't be trusted, or no spot price, in that order.
    """
    return resolved_legs(with_legs(studies, legs), prices)


def priced(studies: DataFrame, prices: DataFrame) -> DataFrame:
    """studies that have their raw_legs, with legs resolved at spot (in leg order), their sums, the first leg_error and fx_rate.

    Aggregate and join are by study_id, so on a table bucketed by it nothing is shuffled, and what
    a reader doesn't select isn't worked out. Studies without legs have null for all sums.
    """
    r = resolved_legs(studies, prices)
    sums = r.groupBy("study_id").agg(
        F.count("*").alias("n_legs"), F.count_if("supported").alias("n_supported"), F.sum("delta_revenue").alias("delta_revenue"), F.sum("deck_revenue").alias("total_revenue"),
        F.sum(F.when(F.col("supported"), F.col("deck_revenue")).otherwise(0.0)).alias("supported_revenue"),
        F.min_by("leg_error", F.when(F.col("leg_error").isNotNull(), F.col("leg"))).alias("leg_error"),
        F.array_sort(F.collect_list(F.struct("leg", *[c for c in r.columns if c not in ("study_id", "leg")]))).alias("legs"),
    )
    return studies.drop("raw_legs").join(sums, "study_id", "left").withColumn("fx_rate", F.try_element_at(_quotes(prices), F.lit(FX))["price_usd"])


def priced_studies(studies: DataFrame, legs: DataFrame, prices: DataFrame) -> DataFrame:
    """priced of studies and their legs."""
    return priced(with_legs(studies, legs), prices)


def leg_rows(priced: DataFrame) -> DataFrame:
    """A row for each resolved leg of priced studies."""
    return priced.where("legs is not null").select("study_id", F.inline("legs")).drop("far")


def coverage_pct(total: Column, supported: Column) -> Column:
    """Percent of a study's revenue at its own prices that supported metals make; 100 without revenue."""
    return F.when(total > 0, supported / total * 100).otherwise(100.0)


def coverage(priced: DataFrame) -> DataFrame:
    own = priced.where("n_legs is not null")
    return own.select("study_id", F.bround(coverage_pct(F.col("total_revenue"), F.col("supported_revenue")), 1).alias("coverage_pct"), (F.col("n_legs") - F.col("n_supported")).alias("unsupported_legs"))


def project_facts(projects: DataFrame, project_commodities: DataFrame, resources: DataFrame) -> DataFrame:
    """What the revaluation needs of each project: project_id, stage, production_start_date, n_commodities (declared or in resources) and primary_commodity (the smallest of several). A project's rows are reduced to one a metal before they are shuffled."""
    metals = project_commodities.select("project_id", "commodity", "is_primary").union(resources.select("project_id", "commodity", F.lit(False)))
    metals = metals.groupBy("project_id", "commodity").agg(F.bool_or("is_primary").alias("is_primary"))
    metals = metals.groupBy("project_id").agg(F.count("commodity").cast("int").alias("n_commodities"), F.min(F.when(F.col("is_primary"), F.col("commodity"))).alias("primary_commodity"))
    return projects.select("project_id", "stage", "production_start_date").join(metals, "project_id", "left")


def placed(studies: DataFrame, places: DataFrame) -> DataFrame:
    """studies with what is known of their projects: places has a row for each, as of project_facts; without its commodities none are counted. known is null for other projects' studies."""
    columns = [c for c in ("n_commodities", "primary_commodity") if c in places.columns]
    return studies.join(places.select("project_id", "stage", "production_start_date", *columns, F.lit(True).alias("known")), "project_id", "left")


def gated(priced: DataFrame, places: DataFrame | None, as_of: Column) -> DataFrame:
    """priced with stage, tier, elapsed, life and reason: the first that forbids a revaluation (null: none). Without places, priced must be placed already."""
    tier = v.effective_tier(F.col("study_confidence_tier"), F.col("study_stage"))
    s = (priced if places is None else placed(priced, places)).withColumns({"tier": tier, "elapsed": v.elapsed_years(F.col("production_start_date"), as_of)})
    s = s.withColumn("life", v.remaining_life(F.col("mine_life_years"), F.col("elapsed")))
    needed = ("mine_life_years", "discount_rate_pct", "post_tax_npv", "reporting_currency")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in needed]))
    aud = F.col("reporting_currency") == "AUD"
    reason = (
        F.when(F.col("known").isNull(), "study_not_found")
        .when(F.col("header_tier") == "conceptual", "not_revaluable_tier:conceptual_by_header")
        .when(~v.revaluable(F.col("tier")), F.concat(F.lit("not_revaluable_tier:"), F.coalesce("tier", F.lit("none"))))
        .when(F.size(missing) > 0, F.concat(F.lit("missing_fields:"), F.array_join(missing, ",")))
        .when(~F.col("reporting_currency").isin("AUD", "USD"), F.concat(F.lit("reporting_currency_not_supported:"), F.col("reporting_currency")))
        .when(F.col("n_legs").isNull(), "no_study_commodities")
        .when(aud & F.col("fx_rate").isNull(), "fx_missing:AUDUSD")
        .when(F.col("leg_error").isNotNull(), F.col("leg_error"))
        .when(F.col("n_supported") == 0, "not_revaluable_no_supported_commodity")
        .when((F.col("life") > 0) & (F.col("discount_rate_pct") <= 0), "discount_rate_not_positive")
        .when(aud & (F.col("fx_rate") <= 0), "fx_rate_must_be_positive")
    )
    return s.withColumn("reason", reason)


def finalize_npv(delta_revenue: Column, annuity: Column, tax_pct: Column, npv: Column, currency: Column, fx: Column) -> dict[str, Column]:
    """delta_npv (millions of the reporting currency), npv_spot, npv_uplift to 2 places and npv_uplift_pct, over |npv|, to 4; half to even."""
    millions = delta_revenue * annuity * (1 - tax_pct / 100) / 1e6
    delta = F.when(currency == "AUD", millions / fx).when(currency == "USD", millions)
    pct = F.when(npv == 0, 0.0).otherwise(delta / F.abs(npv))
    return {"delta_npv": delta, "npv_spot": F.bround(npv + delta, 2), "npv_uplift": F.bround(delta, 2), "npv_uplift_pct": F.bround(pct, 4)}


def npv_warnings(npv: Column, pct: Column) -> list[Column]:
    return [
        F.when(npv == 0, "npv_dfs_zero_pct_undefined"), F.when(npv < 0, "npv_dfs_negative_pct_vs_abs"),
        F.when(F.abs(pct) > v.EXTREME_UPLIFT, F.concat(F.lit("extreme_uplift_check_inputs:"), F.format_string("%.1f", F.bround(pct, 1)))), F.lit("royalty_not_netted_uplift_gross_of_royalties"),
    ]


def tax_terms(raw: Column) -> tuple[Column, list[Column]]:
    return F.coalesce(v.tax_rate(raw), F.lit(v.DEFAULT_TAX_PCT)), [F.when(raw.isNull(), "tax_rate_defaulted_to_30.00pct")]


def valued(passed: DataFrame) -> DataFrame:
    """Studies that pass the gate with tax_used, annuity, coverage_pct and their value at spot (finalize_npv)."""
    tax, _ = tax_terms(F.col("tax_rate_pct"))
    s = passed.withColumns({"tax_used": tax, "annuity": F.when(F.col("life") > 0, v.annuity(F.col("discount_rate_pct"), F.col("life"))).otherwise(0.0), "coverage_pct": coverage_pct(F.col("total_revenue"), F.col("supported_revenue"))})
    return s.withColumns(finalize_npv(F.col("delta_revenue"), F.col("annuity"), F.col("tax_used"), F.col("post_tax_npv"), F.col("reporting_currency"), F.col("fx_rate")))


def revalue_basket(gated_studies: DataFrame, as_of: Column) -> DataFrame:
    """Net present value at spot of the studies that pass the gate, with warnings in a fixed order.

    With n_commodities a basket is told that lacks metals of its project. Numbers
    inside warnings are rounded; the columns hold them whole.
    """
    s = valued(gated_studies.where("reason is null"))
    s = s if "n_commodities" in s.columns else s.withColumn("n_commodities", F.lit(None).cast("long"))
    _, tax_default = tax_terms(F.col("tax_rate_pct"))
    npv = F.col("post_tax_npv")
    pct = F.when(npv == 0, 0.0).otherwise(F.col("delta_npv") / F.abs(npv))
    produces = F.col("elapsed").isNotNull()
    age = F.datediff(as_of, F.col("study_date")) / 365.25
    share, years = F.format_string("%.1f", F.bround("coverage_pct", 1)), F.format_string("%.1f", F.bround(age, 1))
    first = F.array_compact(F.array(
        *tax_default, F.when(produces, F.format_string("remaining_life_%.2fy_of_%.1fy", F.bround("life", 2), F.col("mine_life_years"))), F.when(F.col("life") <= 0, "mine_depleted_no_remaining_life"),
        *npv_warnings(npv, pct), F.when(~produces, "developer_pre_production_timing_not_discounted"),
    ))
    last = F.array_compact(F.array(
        v.tax_warning(F.col("tax_rate_pct")), F.concat(F.lit("coverage_pct:"), share), F.when(F.col("coverage_pct") < 100, F.concat(F.lit("partial_basket_coverage:"), share, F.lit("pct"))),
        F.when(F.col("n_commodities") > F.col("n_legs"), F.concat(F.lit("basket_legs_incomplete:"), F.col("n_legs").cast("string"), F.lit("of"), F.col("n_commodities").cast("string"), F.lit("_metals_modeled"))),
        F.when(age > STALE_YEARS, F.concat(F.lit("stale_study:age="), years, F.lit("y_deck_and_costs_outdated"))),
        F.when((age > STALE_YEARS) & produces, F.concat(F.lit("depletion_from_stale_study:study_date="), F.col("study_date").cast("string"), F.lit("_age="), years, F.lit("y_remaining_life_may_be_understated"))),
    ))
    end = F.array_compact(F.array(
        F.when((F.col("stage") == "production") & ~produces, "producer_missing_start_date_no_depletion_uplift_overstated"),
        F.when(F.col("needs_review"), F.concat(F.lit("study_needs_review:"), F.coalesce("review_reason", F.lit("unspecified")))),
    ))
    of_legs = F.flatten(F.transform("legs", lambda x: x["leg_warnings"]))
    far = F.array_compact(F.transform("legs", lambda x: x["far"]))
    return s.withColumns({"warnings": F.concat(first, of_legs, last, far, end), "method_version": F.lit("first_order_v4")})


def revalue_single(inputs: DataFrame) -> DataFrame:
    """One metal's revaluation ("first_order_v3"): rows of commodity, deck, spot_price, production, production_unit, mine_life_years, elapsed, discount_rate_pct, tax_rate_pct, npv, reporting_currency and fx_rate.

    Adds annuity, tax_used, delta_npv, npv_spot, npv_uplift, npv_uplift_pct and error (the first that applies; then the values are null).
    """
    metal, unit, currency = F.col("commodity"), F.col("production_unit"), F.col("reporting_currency")
    tax, _ = tax_terms(F.col("tax_rate_pct"))
    d = inputs.withColumns({"life": v.remaining_life(F.col("mine_life_years"), F.col("elapsed")), "tax_used": tax})
    d = d.withColumn("annuity", F.when(F.col("life") > 0, v.annuity(F.col("discount_rate_pct"), F.col("life"))).otherwise(0.0))
    error = (
        F.when(~metal.isin(*v.SUPPORTED), F.concat(F.lit("unsupported_commodity:"), metal))
        .when(v.price_basis_error(metal, unit).isNotNull(), v.price_basis_error(metal, unit))
        .when((F.col("life") > 0) & (F.col("discount_rate_pct") <= 0), "discount_rate_not_positive")
        .when((currency == "AUD") & F.col("fx_rate").isNull(), "fx_rate_required_for_aud_reporting")
        .when((currency == "AUD") & (F.col("fx_rate") <= 0), "fx_rate_must_be_positive")
        .when(~currency.isin("AUD", "USD"), F.concat(F.lit("unsupported_reporting_currency:"), currency))
    )
    revenue = v.to_price_basis(F.col("production"), metal, unit) * (F.col("spot_price") - F.col("deck"))
    d = d.withColumn("error", error)
    return d.withColumns({k: F.when(F.col("error").isNull(), c) for k, c in finalize_npv(revenue, F.col("annuity"), F.col("tax_used"), F.col("npv"), currency, F.col("fx_rate")).items()})


def revaluation_rows(basket: DataFrame) -> DataFrame:
    """A row for each revalued study, with the leg that stands for it: the project's primary metal if supported, else the first supported one. study_confidence_tier is the stored one."""
    supported = F.filter("legs", lambda x: x["supported"])
    rep = F.coalesce(F.get(F.filter(supported, lambda x: x["commodity"] == F.col("primary_commodity")), F.lit(0)), F.get(supported, F.lit(0)))
    return basket.withColumn("_rep", rep).select(
        "study_id", "project_id", "company_id", "_rep.commodity", F.col("_rep.deck").alias("price_dfs"), F.col("_rep.spot_price").alias("price_spot"), F.col("_rep.spot_id").alias("price_spot_id"),
        F.col("_rep.production").alias("annual_production"), "_rep.production_unit", F.when(F.col("reporting_currency") == "AUD", F.col("fx_rate")).alias("fx_rate"),
        "mine_life_years", F.col("life").alias("remaining_life_years"), "discount_rate_pct", F.col("tax_used").alias("tax_rate_pct"), F.col("annuity").alias("annuity_factor"),
        F.col("post_tax_npv").alias("npv_dfs"), "npv_spot", "npv_uplift", "npv_uplift_pct", "method_version", "study_confidence_tier", "warnings",
    )


def revaluation_leg_rows(basket: DataFrame) -> DataFrame:
    """All legs, supported or not, of the revalued studies."""
    return leg_rows(basket).select(
        "study_id", "leg", "commodity", "supported", F.col("deck").alias("price_dfs"), F.col("spot_price").alias("price_spot"), F.col("spot_id").alias("price_spot_id"),
        F.col("production").alias("annual_production"), "production_unit", F.bround("delta_revenue", 2).alias("delta_revenue_annual_usd"), F.col("deck_revenue").alias("dfs_metal_revenue_usd"),
    )


def distinct_commodities(project_commodities: DataFrame, resources: DataFrame) -> DataFrame:
    both = project_commodities.select("project_id", "commodity").union(resources.select("project_id", "commodity")).where("commodity is not null").distinct()
    return both.groupBy("project_id").agg(F.count("*").alias("n_commodities")).withColumn("multi", F.col("n_commodities") > 1)


def representative_leg(resolved: DataFrame) -> DataFrame:
    """The supported leg of the primary commodity (primary_commodity, or is_primary without that column), else the first supported one."""
    primary = F.col("commodity").eqNullSafe(F.col("primary_commodity")) if "primary_commodity" in resolved.columns else F.col("is_primary")
    return top(resolved.where("supported"), ["study_id"], [F.desc(primary), F.col("leg")])


def latest_revaluable(studies: DataFrame, revals: DataFrame, as_of: Column, tier: Column | None = None) -> DataFrame:
    """The newest revaluable study of each project among those with a revaluation; future-dated ones last. tier: the stored one, unless another is given."""
    fit = v.revaluable(F.col("study_confidence_tier") if tier is None else tier)
    ran = studies.where(fit).join(revals.select("study_id"), "study_id", "left_semi")
    future = F.when(F.col("study_date") > as_of, 1).otherwise(0)
    return top(ran, ["project_id"], [future, F.desc_nulls_last("study_date"), F.desc("study_id")])


def stale_revaluations(studies: DataFrame, revals: DataFrame, now: Column, max_age_hours: float = 20) -> DataFrame:
    """(study_id, last_computed) of those latest revaluable studies whose newest run is older than max_age_hours. Studies without a stored tier count by their stage."""
    tier = v.effective_tier(F.col("study_confidence_tier"), F.col("study_stage"))
    latest = latest_revaluable(studies, revals, now.cast("date"), tier).select("study_id")
    last = revals.join(latest, "study_id", "left_semi").groupBy("study_id").agg(F.max("computed_at").alias("last_computed"))
    return last.where(F.col("last_computed") < now - F.make_dt_interval(hours=F.lit(max_age_hours)))


def backfill_candidates(studies: DataFrame, revals: DataFrame, companies: DataFrame, ticker: str | None = None) -> DataFrame:
    """Studies stored as definitive or indicative without a revaluation, by ticker and study. Those that lack fields are candidates too; the sweep tells them as errors."""
    s = studies.where(v.revaluable(F.col("study_confidence_tier"))).join(revals.where("study_id is not null").select("study_id"), "study_id", "left_anti")
    s = s.join(companies.select("company_id", "ticker"), "company_id")
    return (s.where(F.col("ticker") == ticker) if ticker else s).select("study_id", "ticker", "study_date").orderBy("ticker", "study_id")


def sweep_stats(gated_studies: DataFrame, kinds: bool = False) -> DataFrame:
    """Outcomes of a sweep in one row: every refusal is an error, and a study that passes is refreshed; none is skipped.

    kinds also parts the errors into unfit (UNFIT) and failed (all others: numbers, exchange rate, spot prices).
    """
    ok, unfit = F.col("reason").isNull(), F.col("reason").rlike(UNFIT)
    parted = [F.count_if(unfit).alias("unfit"), F.count_if(~ok & ~unfit).alias("failed")] if kinds else []
    return gated_studies.agg(F.count("*").alias("total"), F.count_if(ok).alias("refreshed"), F.lit(0).cast("long").alias("skipped"), F.count_if(~ok).alias("errors"), *parted)


def reval_summary(studies: DataFrame, revals: DataFrame, companies: DataFrame, projects: DataFrame) -> DataFrame:
    """The newest run of each company's newest study of a DFS stage (here the stage counts, not the stored tier), with the change from deck to spot."""
    dfs = studies.where(v.tier_of(F.col("study_stage")) == "definitive").join(revals, ["study_id", "project_id", "company_id"])
    one = top(dfs, ["company_id"], [F.desc_nulls_last("study_date"), F.desc("study_id"), F.desc("computed_at"), F.desc("revaluation_id")])
    one = one.join(companies.select("company_id", "ticker"), "company_id").join(projects.select("project_id", "project_name"), "project_id", "left")
    return one.select("ticker", "project_name", "study_id", "commodity", price_change_pct(F.col("price_dfs"), F.col("price_spot")).alias("price_change_pct"), "npv_spot", "npv_uplift_pct")


def price_change_pct(deck: Column, spot: Column) -> Column:
    return F.bround((spot / F.nullif(deck, F.lit(0.0)) - 1) * 100, 2)
