"""Queries of the revaluation and of its building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import valuation as v
from ..operators import prices, refresh, revaluation
from ..sources import facts
from .base import BAD, EFFECTIVE, FACTOR, REVALUABLE, TAX, TIER, day, now, query, rounded
from .bind import view

NUMBER = r"regexp_replace(printf('%.4f', round_even({0}, 4)), '\.?0+$', '')"
METALS = "('Au', 'Ag', 'Cu', 'Pd', 'Pt', 'U3O8')"
AUD = r"regexp_matches(upper(unit), 'AUD|(^|[^CU])A\$|\$A([^A-Z$]|$)')"
PER_TONNE = "(regexp_matches(replace(lower(coalesce(unit, '')), ' ', ''), '/t|/mt|pertonne') and not regexp_matches(replace(lower(coalesce(unit, '')), ' ', ''), '/lb|lb$'))"
LATEST = "select commodity, arg_max(price_usd, (fetched_at, price_id)) as price_usd, arg_max(price_id, (fetched_at, price_id)) as price_id from commodity_prices where fetched_at <= timestamp '2024-01-29 12:00:00' group by commodity"
ENTRY = """list_filter(from_json(assumed_price_deck, '[{"commodity":"VARCHAR","price":"DOUBLE","unit":"VARCHAR"}]'), lambda x: x.commodity = l.commodity)[1]"""
LEGS = f"""latest as ({LATEST}), fx as (select max(price_usd) as fx from latest where commodity = 'AUDUSD'),
    found as (select l.*, {ENTRY} as e from study_commodities l join studies s on s.study_id = l.study_id),
    priced as (select found.*, e.price as price, e.unit as unit, fx from found, fx),
    marked as (select *, coalesce({AUD}, false) and price is not null as aud, {PER_TONNE} as per_tonne, case when commodity = 'Cu' and ({PER_TONNE} or price > 100) then price / 2204.62262 else price end as usd,
        case when commodity in {METALS} then {BAD} end as refused, case when commodity in {METALS} then case when {BAD} is null then annual_production * {FACTOR} end else annual_production end as production from priced),
    decked as (select *, case when aud then usd * fx else usd end as deck from marked),
    known as (select *, coalesce(commodity in {METALS} and deck is not null and production is not null, false) as supported from decked),
    resolved as (select k.*, case when supported then p.price_usd end as spot_price, case when supported then p.price_id end as spot_id, production * case when supported and k.commodity = 'Cu' then 2204.62262 else 1 end as basis,
        case when aud and fx is null then 'fx_missing:AUDUSD' when refused is not null then refused when supported and p.price_usd is null then 'spot_missing:' || k.commodity end as leg_error,
        list_filter([case when k.commodity = 'Cu' and price is not null then case when per_tonne then 'cu_price_unit_t_to_lb:' || {NUMBER.format('price')} || coalesce(unit, 'None') when price > 100 then 'cu_price_magnitude_t_to_lb:' || {NUMBER.format('price')} || coalesce(unit, 'None') end end, case when aud then 'price_deck_aud_to_usd_' || k.commodity || ':' || unit end,
            case when k.commodity in {METALS} and refused is null and {FACTOR.replace('commodity', 'k.commodity')} > 1 then 'production_magnitude_scaled_' || k.commodity || '_' || {NUMBER.format('annual_production')} || '_x' || {FACTOR.replace('commodity', 'k.commodity')} end], lambda x: x is not null) as leg_warnings
        from known k left join latest p on p.commodity = k.commodity),
    moved as (select *, case when supported then basis * (spot_price - deck) else 0 end as delta_revenue, coalesce(basis * deck, 0) as deck_revenue, case when supported and deck < spot_price / 2 then 'deck_far_below_spot_' || commodity || ':' || {NUMBER.format('deck')} || '_vs_' || {NUMBER.format('spot_price')} end as far from resolved)"""
SUMS = f"""{LEGS}, sums as (select study_id, count(*) as n_legs, count(*) filter (where supported) as n_supported, sum(delta_revenue) as delta_revenue, sum(deck_revenue) as total_revenue, sum(case when supported then deck_revenue else 0 end) as supported_revenue,
        arg_min(leg_error, leg) filter (where leg_error is not null) as first_error, flatten(list(leg_warnings order by leg)) as leg_warnings, list(far order by leg) filter (where far is not null) as far from moved group by study_id)"""
GATED = f"""{SUMS}, terms as (select s.*, p.stage, p.production_start_date, {EFFECTIVE} as tier, case when date_diff('day', p.production_start_date, date '2001-09-01') > 0 then date_diff('day', p.production_start_date, date '2001-09-01') / 365.25 end as elapsed, p.project_id is not null as has_project
        from studies s left join projects p on p.project_id = s.project_id),
    lives as (select *, case when elapsed is null then mine_life_years else greatest(mine_life_years - elapsed, 0.0) end as life from terms),
    gated as (select t.*, n_legs, n_supported, delta_revenue, total_revenue, supported_revenue, leg_warnings, far, fx,
        case when not has_project then 'study_not_found' when header_tier = 'conceptual' then 'not_revaluable_tier:conceptual_by_header' when tier = 'conceptual' then 'not_revaluable_tier:conceptual'
            when mine_life_years is null or post_tax_npv is null then 'missing_fields:' || concat_ws(',', case when mine_life_years is null then 'mine_life_years' end, case when post_tax_npv is null then 'post_tax_npv' end)
            when reporting_currency not in ('AUD', 'USD') then 'reporting_currency_not_supported:' || reporting_currency when n_legs is null then 'no_study_commodities' when reporting_currency = 'AUD' and fx is null then 'fx_missing:AUDUSD'
            when first_error is not null then first_error when n_supported = 0 then 'not_revaluable_no_supported_commodity' when life > 0 and discount_rate_pct <= 0 then 'discount_rate_not_positive' when reporting_currency = 'AUD' and fx <= 0 then 'fx_rate_must_be_positive' end as reason
        from lives t left join sums u on u.study_id = t.study_id, fx)"""
BASKET = f"""{GATED}, metals as (select project_id, count(distinct commodity) as n_commodities from (select project_id, commodity from project_commodities union select project_id, commodity from resources) group by project_id),
    termed as (select g.*, n_commodities, coalesce({TAX}, 30.0) as tax_used, case when life > 0 then round_even((1 - pow(1 + discount_rate_pct / 100, -life)) / (discount_rate_pct / 100), 4) else 0 end as annuity,
        case when total_revenue > 0 then supported_revenue / total_revenue * 100 else 100 end as coverage_pct, date_diff('day', study_date, date '2001-09-01') / 365.25 as age from gated g left join metals m on m.project_id = g.project_id where reason is null),
    valued as (select *, delta_revenue * annuity * (1 - tax_used / 100) / 1e6 / case when reporting_currency = 'AUD' then fx else 1 end as delta_npv from termed),
    basket as (select *, case when post_tax_npv = 0 then 0 else delta_npv / abs(post_tax_npv) end as pct, printf('%.1f', round_even(coverage_pct, 1)) as share from valued)"""


def _latest(s: SparkSession, d: str) -> DataFrame:
    return prices.latest_price(view(s, d, "commodity_prices"), now())


#: What the revaluation reads of a study.
STUDY = (
    "study_id", "project_id", "company_id", "study_date", "study_stage", "study_confidence_tier", "header_tier", "mine_life_years", "discount_rate_pct", "tax_rate_pct", "post_tax_npv", "reporting_currency", "needs_review", "review_reason", "assumed_price_deck",
)


def _studies(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "studies")


def _legs(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "study_commodities")


def _places(s: SparkSession, d: str) -> DataFrame:
    return revaluation.project_facts(view(s, d, "projects"), view(s, d, "project_commodities"), view(s, d, "resources"))


def _study_facts(s: SparkSession, d: str) -> DataFrame:
    """Studies with raw_legs and what is known of their projects. Written once: orders and lineitem are dealt by study before their views' wide columns, and only keys go by project and back."""
    paths = [f"{d}/{t}.parquet" for t in ("orders", "lineitem")]

    def rows() -> DataFrame:
        n = facts.parts(s, paths)
        place = revaluation.placed(_studies(s, d).select("study_id", "project_id"), _places(s, d))
        place = place.repartition(n, "study_id").groupBy("study_id").agg(F.collect_set(F.struct(*[c for c in place.columns if c != "study_id"])).alias("_places"))
        studies = view(s, d, "studies", (n, "o_orderkey")).select(*STUDY)
        own = F.get(F.filter("_places", lambda p: p["project_id"].eqNullSafe(F.col("project_id"))), F.lit(0))
        out = revaluation.with_legs(studies, view(s, d, "study_commodities", (n, "l_orderkey"))).join(place, "study_id", "left").withColumn("_place", own)
        return out.select(*[c for c in STUDY if c != "assumed_price_deck"], "raw_legs", *[F.col(f"_place.{c}").alias(c) for c in ("stage", "production_start_date", "n_commodities", "primary_commodity", "known")])

    return facts.loaded(s, "study_facts", paths, "study_id", rows, dealt=True)


def _priced(s: SparkSession, d: str) -> DataFrame:
    return revaluation.priced(_study_facts(s, d), _latest(s, d))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    return revaluation.resolved_legs(_study_facts(s, d), _latest(s, d))


def _gated(s: SparkSession, d: str, priced: DataFrame | None = None) -> DataFrame:
    priced = _priced(s, d) if priced is None else priced
    return revaluation.gated(priced, None if "known" in priced.columns else _places(s, d), day())


def _basket(s: SparkSession, d: str, priced: DataFrame | None = None) -> DataFrame:
    return revaluation.revalue_basket(_gated(s, d, priced), day())


@query(f"with {BASKET} select study_id, project_id, reporting_currency, n_supported, round(life, 4) as life, annuity, tax_used, round(post_tax_npv + delta_npv, 2) as npv_spot, round(delta_npv, 2) as npv_uplift, round(coverage_pct, 4) as coverage_pct from basket")
def revalue_basket(s: SparkSession, d: str) -> DataFrame:
    r = lambda c, n: rounded(c, n).alias(c)
    return _basket(s, d).select("study_id", "project_id", "reporting_currency", "n_supported", r("life", 4), "annuity", "tax_used", r("npv_spot", 2), r("npv_uplift", 2), r("coverage_pct", 4))


@query(f"""with {BASKET} select study_id, array_to_string(list_filter([case when tax_rate_pct is null then 'tax_rate_defaulted_to_30.00pct' end,
        case when elapsed is not null then printf('remaining_life_%.2fy_of_%.1fy', round_even(life, 2), mine_life_years) end, case when life <= 0 then 'mine_depleted_no_remaining_life' end, case when post_tax_npv = 0 then 'npv_dfs_zero_pct_undefined' end,
        case when post_tax_npv < 0 then 'npv_dfs_negative_pct_vs_abs' end, case when abs(pct) > 5 then 'extreme_uplift_check_inputs:' || printf('%.1f', round_even(pct, 1)) end, 'royalty_not_netted_uplift_gross_of_royalties', case when elapsed is null then 'developer_pre_production_timing_not_discounted' end,
        case when len(leg_warnings) > 0 then array_to_string(leg_warnings, '; ') end, case when tax_rate_pct = 0 then 'tax_rate_zero_pct_kept' when tax_rate_pct < 1 then 'tax_rate_fraction_scaled_' || {NUMBER.format('tax_rate_pct')} || '_to_' || printf('%.1f', {TAX}) || 'pct' end, 'coverage_pct:' || share, case when coverage_pct < 100 then 'partial_basket_coverage:' || share || 'pct' end,
        case when n_commodities > n_legs then 'basket_legs_incomplete:' || n_legs || 'of' || n_commodities || '_metals_modeled' end, case when age > 3 then 'stale_study:age=' || printf('%.1f', round_even(age, 1)) || 'y_deck_and_costs_outdated' end, case when age > 3 and elapsed is not null then 'depletion_from_stale_study:study_date=' || study_date || '_age=' || printf('%.1f', round_even(age, 1)) || 'y_remaining_life_may_be_understated' end,
        case when len(far) > 0 then array_to_string(far, '; ') end, case when stage = 'production' and elapsed is null then 'producer_missing_start_date_no_depletion_uplift_overstated' end, case when needs_review then 'study_needs_review:' || coalesce(review_reason, 'unspecified') end], lambda x: x is not null), '; ') as warnings from basket""")
def reval_warnings(s: SparkSession, d: str) -> DataFrame:
    return _basket(s, d).select("study_id", F.array_join("warnings", "; ").alias("warnings"))


@query(f"with {GATED} select study_id, tier, reason from gated")
def reval_gate(s: SparkSession, d: str) -> DataFrame:
    return _gated(s, d).select("study_id", "tier", "reason")


@query(f"with {LEGS} select study_id, leg, commodity, supported, spot_id, round(deck, 6) as deck, round(production, 2) as production, leg_error, array_to_string(leg_warnings, '; ') as leg_warnings from moved")
def resolve_legs(s: SparkSession, d: str) -> DataFrame:
    return _resolved(s, d).select("study_id", "leg", "commodity", "supported", "spot_id", rounded("deck", 6).alias("deck"), rounded("production", 2).alias("production"), "leg_error", F.array_join("leg_warnings", "; ").alias("leg_warnings"))


@query(f"with {SUMS} select study_id, round_even(case when total_revenue > 0 then supported_revenue / total_revenue * 100 else 100 end, 1) as coverage_pct, n_legs - n_supported as unsupported_legs from sums")
def coverage(s: SparkSession, d: str) -> DataFrame:
    return revaluation.coverage(_priced(s, d))


@query(f"with {LEGS} select study_id, leg, commodity from (select *, row_number() over (partition by study_id order by is_primary desc, leg) as r from moved where supported) where r = 1")
def representative_leg(s: SparkSession, d: str) -> DataFrame:
    return revaluation.representative_leg(_resolved(s, d)).select("study_id", "leg", "commodity")


@query("select project_id, count(distinct commodity) as n_commodities, count(distinct commodity) > 1 as multi from (select project_id, commodity from project_commodities union select project_id, commodity from resources) group by project_id")
def distinct_commodities(s: SparkSession, d: str) -> DataFrame:
    return revaluation.distinct_commodities(view(s, d, "project_commodities"), view(s, d, "resources"))


SINGLE = """select study_id, l.commodity, 50.0 + study_id % 40 as deck, 60.0 + study_id % 70 as spot_price, l.annual_production as production, case study_id % 5 when 0 then 't' when 1 then 'lb' else 'oz' end as production_unit, mine_life_years,
    case when study_id % 3 = 0 then cast(study_id % 25 as double) end as elapsed, discount_rate_pct, tax_rate_pct, post_tax_npv as npv, reporting_currency, case when study_id % 10 = 3 then null else 0.6452 end as fx_rate
    from studies join study_commodities l using (study_id) where l.annual_production is not null and mine_life_years is not null and post_tax_npv is not null"""


@query(f"""with inputs as ({SINGLE}), lived as (select *, case when elapsed is null then mine_life_years else greatest(mine_life_years - elapsed, 0.0) end as life, coalesce({TAX}, 30.0) as tax_used from inputs),
    a as (select *, case when life > 0 and discount_rate_pct > 0 then round_even((1 - pow(1 + discount_rate_pct / 100, -life)) / (discount_rate_pct / 100), 4) when life <= 0 then 0 end as annuity,
        case when commodity not in {METALS} then 'unsupported_commodity:' || commodity when commodity in ('Au', 'Ag', 'Pd', 'Pt') and production_unit <> 'oz' then commodity || '_production_must_be_in_oz' when commodity = 'Cu' and production_unit = 'oz' then 'Cu_production_must_be_in_t_or_lb'
            when commodity = 'U3O8' and production_unit = 'oz' then 'U3O8_production_must_be_in_lb_or_t' when life > 0 and discount_rate_pct <= 0 then 'discount_rate_not_positive' when reporting_currency = 'AUD' and fx_rate is null then 'fx_rate_required_for_aud_reporting'
            when reporting_currency not in ('AUD', 'USD') then 'unsupported_reporting_currency:' || reporting_currency end as error from lived),
    m as (select *, case when error is null then production * case when commodity = 'Cu' and production_unit = 't' then 2204.62262 else 1 end * (spot_price - deck) * annuity * (1 - tax_used / 100) / 1e6 / case when reporting_currency = 'AUD' then fx_rate else 1 end end as delta from a)
    select study_id, commodity, annuity, tax_used, error, round(delta, 2) as npv_uplift, round_even(case when npv = 0 then case when error is null then 0 end else delta / abs(npv) end, 4) as npv_uplift_pct from m""")
def revalue_single(s: SparkSession, d: str) -> DataFrame:
    k = F.col("study_id")
    inputs = view(s, d, "studies").drop("annual_production").join(view(s, d, "study_commodities"), "study_id").where("annual_production is not null and mine_life_years is not null and post_tax_npv is not null").select(
        "study_id", "commodity", (50.0 + k % 40).alias("deck"), (60.0 + k % 70).alias("spot_price"), F.col("annual_production").alias("production"),
        F.when(k % 5 == 0, "t").when(k % 5 == 1, "lb").otherwise("oz").alias("production_unit"), "mine_life_years", F.when(k % 3 == 0, (k % 25).cast("double")).alias("elapsed"),
        "discount_rate_pct", "tax_rate_pct", F.col("post_tax_npv").alias("npv"), "reporting_currency", F.when(k % 10 != 3, 0.6452).alias("fx_rate"),
    )
    out = revaluation.revalue_single(inputs)
    return out.select("study_id", "commodity", "annuity", "tax_used", "error", rounded("npv_uplift", 2).alias("npv_uplift"), "npv_uplift_pct")


@query("""select study_id, round(delta_npv, 2) as delta_npv, round(npv + delta_npv, 2) as npv_spot, round_even(case when npv = 0 then 0 else delta_npv / abs(npv) end, 4) as npv_uplift_pct, concat_ws('; ', case when npv = 0 then 'npv_dfs_zero_pct_undefined' end, case when npv < 0 then 'npv_dfs_negative_pct_vs_abs' end,
        case when abs(case when npv = 0 then 0 else delta_npv / abs(npv) end) > 5 then 'extreme_uplift_check_inputs:' || printf('%.1f', round_even(delta_npv / abs(npv), 1)) end, 'royalty_not_netted_uplift_gross_of_royalties') as warnings
    from (select study_id, post_tax_npv as npv, (initial_capex * 1e6 - 5e7) * 7.7217 * (1 - 30.0 / 100) / 1e6 / case when reporting_currency = 'AUD' then 0.6452 else 1 end as delta_npv from studies where post_tax_npv is not null and initial_capex is not null and reporting_currency in ('AUD', 'USD'))""")
def finalize_npv(s: SparkSession, d: str) -> DataFrame:
    st = view(s, d, "studies").where("post_tax_npv is not null and initial_capex is not null and reporting_currency in ('AUD', 'USD')")
    npv = F.col("post_tax_npv")
    out = st.withColumns(revaluation.finalize_npv(F.col("initial_capex") * 1e6 - 5e7, F.lit(7.7217), F.lit(30.0), npv, F.col("reporting_currency"), F.lit(0.6452)))
    pct = F.when(npv == 0, 0.0).otherwise(F.col("delta_npv") / F.abs(npv))
    return out.select("study_id", rounded("delta_npv", 2).alias("delta_npv"), rounded("npv_spot", 2).alias("npv_spot"), "npv_uplift_pct", F.concat_ws("; ", *revaluation.npv_warnings(npv, pct)).alias("warnings"))


@query(f"""with {BASKET}, primaries as (select project_id, min(commodity) as pc from project_commodities where is_primary group by project_id),
    reps as (select * from (select m.*, row_number() over (partition by m.study_id order by m.commodity is not distinct from pc desc, leg) as r from moved m join basket b on b.study_id = m.study_id left join primaries p on p.project_id = b.project_id where supported) where r = 1)
    select b.study_id, b.project_id, b.company_id, r.commodity, round(r.deck, 6) as price_dfs, r.spot_price as price_spot, r.spot_id as price_spot_id, round(r.production, 2) as annual_production, case when r.commodity in ('Au', 'Ag', 'Pd', 'Pt') then 'oz' when r.commodity = 'U3O8' then 'lb' else 't' end as production_unit,
        case when reporting_currency = 'AUD' then b.fx end as fx_rate, round(life, 4) as remaining_life_years, tax_used as tax_rate_pct, annuity as annuity_factor, post_tax_npv as npv_dfs, round(post_tax_npv + delta_npv, 2) as npv_spot, 'first_order_v4' as method_version, study_confidence_tier from basket b join reps r on r.study_id = b.study_id""")
def revaluations(s: SparkSession, d: str) -> DataFrame:
    out = revaluation.revaluation_rows(_basket(s, d))
    r = {"price_dfs": 6, "annual_production": 2, "remaining_life_years": 4, "npv_spot": 2}
    return out.drop("mine_life_years", "discount_rate_pct", "npv_uplift", "npv_uplift_pct", "warnings").withColumns({c: rounded(c, n) for c, n in r.items()})


@query(f"with {BASKET} select m.study_id, leg, m.commodity, supported, round(deck, 6) as price_dfs, spot_price as price_spot, spot_id as price_spot_id, round(m.delta_revenue, 2) as delta_revenue_annual_usd, round(deck_revenue, 2) as dfs_metal_revenue_usd from moved m where m.study_id in (select study_id from basket)")
def revaluation_legs(s: SparkSession, d: str) -> DataFrame:
    out = revaluation.revaluation_leg_rows(_basket(s, d))
    return out.select("study_id", "leg", "commodity", "supported", rounded("price_dfs", 6).alias("price_dfs"), "price_spot", "price_spot_id", "delta_revenue_annual_usd", rounded("dfs_metal_revenue_usd", 2).alias("dfs_metal_revenue_usd"))


def recomputed(s: SparkSession, d: str, moved: list[str], quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revaluations of the studies that moved quotes concern, these studies)."""
    paths = [f"{d}/{t}.parquet" for t in ("orders", "lineitem")]
    index = facts.loaded(s, "studies_by_mover", paths, "study_id", lambda: refresh.by_mover(_study_facts(s, d)), folder_by="mover", dealt=True)
    concerned = refresh.of_moved(index, moved)
    studies = _study_facts(s, d).join(concerned, "study_id", "left_semi")
    return revaluation.revaluation_rows(_basket(s, d, revaluation.priced(studies, quotes))), concerned


@query(f"""with {BASKET}, primaries as (select project_id, min(commodity) as pc from project_commodities where is_primary group by project_id),
    reps as (select * from (select m.*, row_number() over (partition by m.study_id order by m.commodity is not distinct from pc desc, leg) as r from moved m join basket b on b.study_id = m.study_id left join primaries p on p.project_id = b.project_id where supported) where r = 1)
    select b.study_id, r.commodity, r.spot_price as price_spot, r.spot_id as price_spot_id, case when reporting_currency = 'AUD' then b.fx end as fx_rate, round(post_tax_npv + delta_npv, 2) as npv_spot, round(delta_npv, 2) as npv_uplift from basket b join reps r on r.study_id = b.study_id""")
def price_refresh(s: SparkSession, d: str) -> DataFrame:
    """Revaluations at quotes of which those of copper and the exchange rate are two weeks old, brought up to date; the SQL computes everything anew."""
    late = F.col("commodity").isin("Cu", "AUDUSD") & (F.col("fetched_at") > F.lit("2024-01-15").cast("timestamp"))
    old, new = prices.latest_price(view(s, d, "commodity_prices").where(~late), now()), _latest(s, d)
    stored = revaluation.revaluation_rows(_basket(s, d, revaluation.priced(_study_facts(s, d), old)))
    out = refresh.refreshed(stored, *recomputed(s, d, refresh.moved_quotes(old, new), new))
    return out.select("study_id", "commodity", "price_spot", "price_spot_id", "fx_rate", rounded("npv_spot", 2).alias("npv_spot"), rounded("npv_uplift", 2).alias("npv_uplift"))


RANKED = f"select *, row_number() over (partition by project_id order by case when study_date > date '2000-06-01' then 1 else 0 end, study_date desc nulls last, study_id desc) as r from studies where {EFFECTIVE} in ('definitive', 'indicative') and study_id in (select study_id from revals)"


@query(f"with ranked as ({RANKED}) select study_id, max(computed_at) as last_computed from revals where study_id in (select study_id from ranked where r = 1) group by study_id having max(computed_at) < timestamp '2000-06-01 06:00:00' - interval 20 hour")
def stale_revals(s: SparkSession, d: str) -> DataFrame:
    return revaluation.stale_revaluations(view(s, d, "studies"), view(s, d, "revals"), F.lit("2000-06-01 06:00:00").cast("timestamp"))


@query(f"select study_id, ticker, study_date from studies join companies using (company_id) where {REVALUABLE} and study_id not in (select study_id from revals) order by ticker, study_id")
def backfill_candidates(s: SparkSession, d: str) -> DataFrame:
    return revaluation.backfill_candidates(view(s, d, "studies"), view(s, d, "revals"), view(s, d, "companies"))


@query(f"with {GATED} select count(*) as total, count(*) filter (where reason is null) as refreshed, cast(0 as bigint) as skipped, count(*) filter (where reason is not null) as errors, count(*) filter (where regexp_matches(reason, '^(not_revaluable|missing_fields|reporting_currency|no_study)')) as unfit, count(*) filter (where reason is not null and not regexp_matches(reason, '^(not_revaluable|missing_fields|reporting_currency|no_study)')) as failed from gated")
def sweep_stats(s: SparkSession, d: str) -> DataFrame:
    return revaluation.sweep_stats(_gated(s, d), kinds=True)


@query(f"""with runs as (select s.company_id, s.project_id, s.study_id, r.commodity, price_dfs, price_spot, npv_spot, npv_uplift_pct, row_number() over (partition by s.company_id order by study_date desc nulls last, s.study_id desc, computed_at desc, revaluation_id desc) as k
        from studies s join revals r on r.study_id = s.study_id where {TIER} = 'definitive')
    select ticker, project_name, study_id, commodity, round_even((price_spot / price_dfs - 1) * 100, 2) as price_change_pct, round(npv_spot, 2) as npv_spot, npv_uplift_pct from runs join companies using (company_id) left join projects using (project_id) where k = 1""")
def reval_summary(s: SparkSession, d: str) -> DataFrame:
    out = revaluation.reval_summary(view(s, d, "studies"), view(s, d, "revals"), view(s, d, "companies"), view(s, d, "projects"))
    return out.withColumn("npv_spot", rounded("npv_spot", 2))


@query("select revaluation_id, round_even((price_spot / price_dfs - 1) * 100, 2) as change_pct from revals")
def price_change(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "revals").select("revaluation_id", revaluation.price_change_pct(F.col("price_dfs"), F.col("price_spot")).alias("change_pct"))


DECK = """select study_id, l.commodity, {entry} as e from studies, (values ('Au'), ('Cu'), ('Pt'), ('U3O8'), ('Zn')) as l(commodity)"""


@query(f"select study_id, commodity, e.price as price, e.unit as unit from ({DECK.format(entry=ENTRY)})")
def deck_price(s: SparkSession, d: str) -> DataFrame:
    metals = F.explode(F.array(*[F.lit(m) for m in ("Au", "Cu", "Pt", "U3O8", "Zn")]))
    return view(s, d, "studies").select("study_id", "assumed_price_deck", metals.alias("commodity")).withColumn("e", v.deck_entry(F.col("assumed_price_deck"), F.col("commodity"))).select("study_id", "commodity", "e.price", "e.unit")


UNITS = "('USD/t', 'USD/lb', 'US$ / tonne', 'usd/mt', 'per tonne', 'A$/lb', 'AUD/oz', '$A/oz', '$AUD', 'CA$/oz', 'CAD', 'US$', null)"
UNIT = "case p_partkey % 13 " + " ".join(f"when {i} then {x.strip()}" for i, x in enumerate(UNITS.strip("()").split(", "))) + " end"


def _units(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(UNIT).alias("unit"), (F.col("p_retailprice") / F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(100.0)).alias("price"))


@query(f"select p_partkey, round(case when {PER_TONNE} or price > 100 then price / 2204.62262 else price end, 6) as per_lb, case when {PER_TONNE} then 'cu_price_unit_t_to_lb:' || {NUMBER.format('price')} || coalesce(unit, 'None') when price > 100 then 'cu_price_magnitude_t_to_lb:' || {NUMBER.format('price')} || coalesce(unit, 'None') end as warning from (select p_partkey, {UNIT} as unit, p_retailprice / case when p_partkey % 2 = 0 then 1 else 100 end as price from part)")
def cu_per_lb(s: SparkSession, d: str) -> DataFrame:
    return _units(s, d).select("p_partkey", rounded(v.copper_per_pound(F.col("price"), F.col("unit")), 6).alias("per_lb"), v.copper_warning(F.col("price"), F.col("unit")).alias("warning"))


@query(f"select p_partkey, coalesce({AUD}, false) as is_aud from (select p_partkey, {UNIT} as unit from part)")
def aud_unit(s: SparkSession, d: str) -> DataFrame:
    return _units(s, d).select("p_partkey", v.is_aud_unit(F.col("unit")).alias("is_aud"))


@query("""with x as (select l_orderkey, l_linenumber, l_partkey, l_quantity, case l_partkey % 4 when 0 then 'oz' when 1 then 't' when 2 then 'lb' else null end as unit, case l_linenumber when 1 then 'Au' when 2 then 'Ag' when 3 then 'Cu' when 4 then 'Pd' when 5 then 'Pt' when 6 then 'U3O8' else 'Ni' end as commodity from lineitem),
    e as (select *, case when commodity in ('Au', 'Ag', 'Pd', 'Pt') then case when unit is distinct from 'oz' then commodity || '_production_must_be_in_oz' end when commodity = 'Cu' then case when coalesce(unit, 'oz') = 'oz' then 'Cu_production_must_be_in_t_or_lb' end
        when commodity = 'U3O8' then case when coalesce(unit, 'oz') = 'oz' then 'U3O8_production_must_be_in_lb_or_t' end else 'unsupported_commodity:' || commodity end as error from x)
    select l_orderkey, l_linenumber, l_partkey, error, round(case when error is null then l_quantity * case when commodity = 'Cu' and unit = 't' then 2204.62262 else 1 end end, 4) as production from e""")
def price_basis(s: SparkSession, d: str) -> DataFrame:
    k, metals = F.col("l_partkey") % 4, F.array(*[F.lit(m) for m in ("Au", "Ag", "Cu", "Pd", "Pt", "U3O8", "Ni")])
    x = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(k == 0, "oz").when(k == 1, "t").when(k == 2, "lb").alias("unit"), F.get(metals, F.col("l_linenumber") - 1).alias("commodity"))
    metal, unit = F.col("commodity"), F.col("unit")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", v.price_basis_error(metal, unit).alias("error"), rounded(v.to_price_basis(F.col("l_quantity"), metal, unit), 4).alias("production"))


@query("select project_id, round(case when date_diff('day', production_start_date, date '2001-09-01') > 0 then date_diff('day', production_start_date, date '2001-09-01') / 365.25 end, 6) as elapsed from projects")
def elapsed_years(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "projects").select("project_id", rounded(v.elapsed_years(F.col("production_start_date"), day()), 6).alias("elapsed"))


@query("""select study_id, round(annual_production * coalesce(m, 1), 4) as production, case when m <> 1 and annual_production is not null then 'production_normalized_' || annual_production_unit || '_x' || m end as warning
    from (select *, case annual_production_unit when 'koz/yr' then 1000 when 'Moz pa' then 1000000 when 't/yr' then 1 when 'ktpa contained' then 1000 when 'Mlb' then 1000000 end as m from studies)""")
def production_norm(s: SparkSession, d: str) -> DataFrame:
    value, unit = F.col("annual_production"), F.col("annual_production_unit")
    return view(s, d, "studies").select("study_id", rounded(v.production_norm(value, unit), 4).alias("production"), v.production_norm_warning(value, unit).alias("warning"))
