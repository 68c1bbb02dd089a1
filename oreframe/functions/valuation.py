"""Scalar building blocks of the revaluation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the method.
DEFAULT_TAX_PCT = 30.0
EXTREME_UPLIFT = 5.0
SUPPORTED = ("Au", "Ag", "Cu", "Pd", "Pt", "U3O8")
OUNCE_METALS = ("Au", "Ag", "Pd", "Pt")
POUNDS_PER_TONNE = 2204.62262
#: Australian dollars in a price unit in capitals.
AUD_UNIT = r"AUD|(?<![CU])A\$|\$A(?![A-Z$])"
DECK = "array<struct<commodity:string,price:double,unit:string>>"
STAGES = ("production", "care_and_maintenance", "development", "feasibility", "advanced_exploration", "exploration", "unknown")
TIERS = {"definitive": ("DFS", "Updated DFS", "Revised DFS", "FFS"), "indicative": ("PFS", "Updated PFS"), "conceptual": ("Scoping", "PEA")}
UNIT_SCALE = {
    "oz": 1, "ozs": 1, "koz": 1_000, "kozs": 1_000, "moz": 1_000_000, "t": 1, "tonnes": 1, "tonne": 1, "kt": 1_000, "ktpa": 1_000, "mt": 1_000_000, "mtpa": 1_000_000,
    "lb": 1, "lbs": 1, "klb": 1_000, "klbs": 1_000, "mlb": 1_000_000, "mlbs": 1_000_000, "mlbpa": 1_000_000,
}
REGISTRY_STAGES = {
    "operating mine": "production", "producer": "production", "production": "production", "care and maintenance": "care_and_maintenance",
    "construction": "development", "development": "development", "feasibility": "feasibility", "pfs": "feasibility", "dfs": "feasibility",
    "resource definition": "advanced_exploration", "advanced exploration": "advanced_exploration", "exploration": "exploration", "prospect": "exploration",
}


def lookup(key: Column, values: dict, default: object = None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def number(x: Column) -> Column:
    """A number as text: 4 places, half to even, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", F.bround(x, 4)), r"\.?0+$", "")


def annuity(rate_pct: Column, years: Column) -> Column:
    """(1 - (1 + r)^-n) / r to 4 places, half to even; null for rates of 0 or less."""
    r = rate_pct / 100
    return F.when(rate_pct > 0, F.bround((1 - F.pow(1 + r, -years)) / r, 4))


def elapsed_years(start: Column, as_of: Column) -> Column:
    """Years since start; null unless start is before as_of."""
    days = F.datediff(as_of, start)
    return F.when(days > 0, days / 365.25)


def remaining_life(life: Column, elapsed: Column) -> Column:
    return F.when(elapsed.isNull() | (elapsed < 0), life).otherwise(F.greatest(life - elapsed, F.lit(0.0)))


def tax_rate(raw: Column) -> Column:
    """Percent; fractions below 1 are scaled, 0 is kept and null passes."""
    return F.when((raw > 0) & (raw < 1), F.bround(raw * 100, 1)).otherwise(raw)


def tax_warning(raw: Column) -> Column:
    scaled = F.concat(F.lit("tax_rate_fraction_scaled_"), number(raw), F.lit("_to_"), F.format_string("%.1f", tax_rate(raw)), F.lit("pct"))
    return F.when(raw == 0, "tax_rate_zero_pct_kept").when((raw > 0) & (raw < 1), scaled)


def production_error(metal: Column, v: Column) -> Column:
    """Why a yearly production can't be trusted, or null."""
    return (
        F.when((metal == "Au") & (v > 1_000_000), "au_production_implausible_check_lom")
        .when((metal == "Ag") & (v >= 100) & (v < 1000), "ag_production_unit_ambiguous")
        .when((metal == "Pd") & (v > 1_000_000), "pd_production_implausible_check_lom")
        .when((metal == "Pt") & (v > 1_000_000), "pt_production_implausible_check_lom")
        .when((metal == "U3O8") & (v >= 20) & (v < 100_000), "u3o8_production_unit_ambiguous")
        .when((metal == "U3O8") & (v > 30_000_000), "u3o8_production_implausible")
    )


def production_factor(metal: Column, v: Column) -> Column:
    """What a production given in thousands or millions must be multiplied by."""
    return (
        F.when(metal.isin("Au", "Pd", "Pt") & (v < 1000), 1_000)
        .when((metal == "Ag") & (v < 100), 1_000_000)
        .when((metal == "U3O8") & (v < 20), 1_000_000)
        .when((metal == "Cu") & (v < 100), 1_000)
        .otherwise(1)
    )


def production_warning(metal: Column, v: Column) -> Column:
    factor = production_factor(metal, v)
    return F.when(production_error(metal, v).isNull() & (factor > 1), F.concat(F.lit("production_magnitude_scaled_"), metal, F.lit("_"), number(v), F.lit("_x"), factor.cast("string")))


def _says_per_tonne(unit: Column) -> Column:
    u = F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), " ", "")
    return u.rlike("/t|/mt|pertonne") & ~u.rlike("/lb|lb$")


def copper_per_pound(price: Column, unit: Column) -> Column:
    return F.when(_says_per_tonne(unit) | (price > 100), price / POUNDS_PER_TONNE).otherwise(price)


def copper_warning(price: Column, unit: Column) -> Column:
    given = F.concat(number(price), F.coalesce(unit, F.lit("None")))
    return F.when(_says_per_tonne(unit), F.concat(F.lit("cu_price_unit_t_to_lb:"), given)).when(price > 100, F.concat(F.lit("cu_price_magnitude_t_to_lb:"), given))


def is_aud_unit(unit: Column) -> Column:
    """Whether a price unit is in Australian dollars (AUD, A$ or $A; not US$ or CA$)."""
    return F.coalesce(F.upper(unit).rlike(AUD_UNIT), F.lit(False))


def deck_entry(deck: Column, metal: Column) -> Column:
    """(commodity, price, unit) of the first entry of a JSON price deck that is for the metal, or null."""
    return F.get(F.filter(F.from_json(deck, DECK), lambda e: e["commodity"] == metal), F.lit(0))


def basis_unit(metal: Column) -> Column:
    """The unit that production is kept in."""
    return F.when(metal.isin(*OUNCE_METALS), "oz").when(metal == "U3O8", "lb").otherwise("t")


def price_basis_error(metal: Column, unit: Column) -> Column:
    return (
        F.when(metal.isin(*OUNCE_METALS), F.when(~unit.eqNullSafe("oz"), F.concat(metal, F.lit("_production_must_be_in_oz"))))
        .when(metal == "Cu", F.when(~F.coalesce(unit.isin("t", "lb"), F.lit(False)), "Cu_production_must_be_in_t_or_lb"))
        .when(metal == "U3O8", F.when(~F.coalesce(unit.isin("lb", "t"), F.lit(False)), "U3O8_production_must_be_in_lb_or_t"))
        .otherwise(F.concat(F.lit("unsupported_commodity:"), metal))
    )


def to_price_basis(v: Column, metal: Column, unit: Column) -> Column:
    """Production in the unit that the metal's price is for; null where the unit doesn't fit."""
    return F.when(price_basis_error(metal, unit).isNull(), F.when((metal == "Cu") & (unit == "t"), v * POUNDS_PER_TONNE).otherwise(v))


def tier_of(stage: Column) -> Column:
    out = F.lit(None).cast("string")
    for tier, names in TIERS.items():
        out = F.when(stage.isin(*names), tier).otherwise(out)
    return out


def effective_tier(tier: Column, stage: Column) -> Column:
    """The stored tier of a study, or for rows without one that of its stage. Only the gate and the refresh fall back; other readers take the stored one as it is."""
    return F.coalesce(tier, tier_of(stage))


def revaluable(tier: Column) -> Column:
    return F.coalesce(tier.isin("definitive", "indicative"), F.lit(False))


def stage_rank(stage: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage), F.lit(0))


def study_floor(stage: Column, tier: Column) -> Column:
    """The stage, raised to the least that a study of that tier implies."""
    least = F.when(tier.isin("definitive", "indicative"), "feasibility").when(tier == "conceptual", "advanced_exploration")
    rank = F.least(stage_rank(stage), stage_rank(least))
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in STAGES]), (rank - 1).cast("int")), stage)


def _unit_scale(unit: Column) -> Column:
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(unit), "/", " ")), r"\s+"), lambda w: w.isin(*UNIT_SCALE))
    return lookup(F.get(words, 0), UNIT_SCALE)


def production_norm(v: Column, unit: Column) -> Column:
    """v in ounces, tonnes or pounds, by the first known unit word; unchanged without one."""
    return v * F.coalesce(_unit_scale(unit), F.lit(1))


def production_norm_warning(v: Column, unit: Column) -> Column:
    scale = _unit_scale(unit)
    return F.when(v.isNotNull() & (scale != 1), F.concat(F.lit("production_normalized_"), unit, F.lit("_x"), scale.cast("string")))


def runway_quarters(cash: Column, burn: Column) -> Column:
    """Quarters of cash left; null without cash or burn, or when burn isn't positive."""
    return F.when((cash != 0) & (burn > 0), cash / burn)


def runway_label(cash: Column, burn: Column) -> Column:
    """What the runway says: quarters, or that cash grows; null without either figure."""
    some = (cash != 0) & (burn != 0)
    return F.when(some & (burn > 0), F.concat(F.lit("~"), F.bround(cash / burn, 0).cast("long").cast("string"), F.lit(" quarters of runway"))).when(some, "Net cash positive")
