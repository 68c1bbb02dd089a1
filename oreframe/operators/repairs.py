"""Checks and repairs of snapshots, studies, legs and resource estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms as f
from ..functions import text as t
from ..functions import valuation as v
from .common import highest_before, reasons

# Review figures that each type of filing can give.
APPLICABLE = {"cash": ("appendix_5b", "quarterly_activity", "presentation"), "burn": ("appendix_5b", "quarterly_activity"), "shares_fd": ("issue_of_securities", "presentation")}
REASON_NAMES = {"shares_fd": "shares_fd", "cash": "cash", "burn": "opex_burn"}
# Reasons that don't apply to a type.
NOT_APPLICABLE = {
    "appendix_5b": ("missing_shares_fd",), "quarterly_activity": ("missing_shares_fd",), "appendix_2a": ("missing_cash", "missing_opex_burn"), "appendix_3g": ("missing_cash", "missing_opex_burn"),
    "appendix_3h": ("missing_cash", "missing_opex_burn"), "issue_of_securities": ("missing_cash", "missing_opex_burn"), "presentation": ("missing_opex_burn",),
}
# Plausible grades by metal, in the unit usual for it.
GRADES = {"Au": (0.1, 100.0), "Cu": (0.05, 30.0), "U3O8": (50.0, 50000.0), "Li2O": (0.1, 5.0), "Ni": (0.1, 10.0), "Zn": (0.1, 30.0), "Fe": (15.0, 70.0), "Ag": (1.0, 2000.0)}
CURRENCIES = ("USD", "US$", "AUD", "A$", "CAD", "C$")
QUARTER_ENDS = ("03-31", "06-30", "09-30", "12-31")


def review_flags(financials: DataFrame, change: float = 0.5, block: int = 100_000) -> DataFrame:
    """Reasons to review a snapshot: a figure that its type of filing should give is missing, or differs by more than change from the snapshot that was latest when it was inserted.

    Insert order is that of financial_id, of which block numbers are the most that a window runs over. The earlier snapshot is any type's, that of the latest date.
    """
    latest = F.struct("effective_date", "financial_id", "cash", "burn", "shares_fd")
    d = highest_before(financials, ["company_id"], ["financial_id"], F.floor(F.col("financial_id") / block), latest, "p")
    fits = {c: F.col("doc_type").isin(*types) for c, types in APPLICABLE.items()}
    before = {c: F.col(f"p.{c}") for c in fits}
    moved = {c: fits[c] & (before[c] != 0) & (F.abs(F.col(c) - before[c]) / F.abs(before[c]) > change) for c in fits}
    missing = [F.when(fits[c] & F.col(c).isNull(), f"missing_{n}") for c, n in REASON_NAMES.items()]
    return d.withColumn("reason", reasons(*missing, F.when(moved["cash"], "cash_50pct_deviation"), F.when(moved["shares_fd"], "shares_fd_50pct_deviation"), F.when(moved["burn"], "quarterly_opex_burn_50pct_deviation"))).drop("p")


def study_flags(studies: DataFrame) -> DataFrame:
    pre, post = F.col("pre_tax_npv"), F.col("post_tax_npv")
    gap = 1 - post / F.nullif(pre, F.lit(0.0))
    odd = F.concat(F.lit("implied_tax_gap_"), F.format_string("%.1f", F.bround(gap * 100, 1)), F.lit("pct_out_of_band"))
    return studies.withColumn("reason", reasons(
        F.when(pre.isNull(), "missing_pre_tax_npv"), F.when(post.isNull(), "missing_post_tax_npv"),
        F.when((pre != 0) & (post >= pre), "post_tax_npv_ge_pre_tax_npv").when((pre != 0) & ((gap < 0.20) | (gap > 0.45)), odd),
        F.when(F.col("tax_rate_pct").isNull(), "missing_tax_rate"), F.when(F.col("discount_rate_pct") <= 0, "discount_rate_nonpositive"), F.when(F.col("aisc") < 0, "aisc_negative"),
    ))


def study_sanity(studies: DataFrame) -> DataFrame:
    pre, post = F.col("pre_tax_npv"), F.col("post_tax_npv")
    named = sum((F.col("aisc_unit").contains(c).cast("int") for c in CURRENCIES), F.lit(0))
    return studies.withColumn("warning", reasons(
        F.when(post == pre, "npv_post_equals_pre_suspected_duplicate").when(post > pre, "npv_post_gt_pre"),
        F.when(F.col("aisc").isNotNull() & (named >= 2), F.concat(F.lit("aisc_unit_malformed:"), "aisc_unit")),
    ))


def primary_leg_check(studies: DataFrame, legs: DataFrame) -> DataFrame:
    """studies(study_id, primary_commodity, annual_production) against their legs: the primary one missing, or of another volume. Studies without legs pass."""
    any_ = legs.groupBy("study_id").agg(F.lit(True).alias("has_legs"))
    own = legs.groupBy("study_id", "commodity").agg(F.min_by("annual_production", "leg").alias("leg_production"), F.lit(True).alias("found"))
    d = studies.join(any_, "study_id", "left").join(own.withColumnRenamed("commodity", "primary_commodity"), ["study_id", "primary_commodity"], "left")
    warning = F.when(F.col("has_legs") & F.col("found").isNull(), F.concat(F.lit("primary_commodity_missing_from_basket:"), "primary_commodity")).when(F.col("leg_production") != F.col("annual_production"), "primary_production_mismatch")
    return d.select("study_id", warning.alias("warning"))


def discard_future_date(date: Column, as_of: Column) -> Column:
    return F.when(date <= as_of, date)


def first_production(s: Column) -> tuple[Column, Column]:
    """(date, warning): years and months begin on their first day; anything else is null with a warning."""
    x = F.trim(s)
    text = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x).when(x.rlike(r"^\d{4}-\d{2}$"), F.concat(x, F.lit("-01"))).when(x.rlike(r"^\d{4}$"), F.concat(x, F.lit("-01-01")))
    return F.try_to_date(text, "yyyy-MM-dd"), F.when((x != "") & text.isNull(), F.concat(F.lit("first_production_unparseable:"), s))


def minimum_data(studies: DataFrame) -> DataFrame:
    return studies.where(F.coalesce("post_tax_npv", "pre_tax_npv").isNotNull() & F.col("initial_capex").isNotNull())


def clamp_study_date(studies: DataFrame) -> DataFrame:
    """studies(study_date, announcement_date): a date after the announcement, or none, becomes the announcement's."""
    own, said = F.col("study_date"), F.col("announcement_date")
    return studies.withColumns({"date": F.least(own, said), "warning": F.when(own > said, "effective_date_after_announcement_clamped").when(own.isNull() & said.isNotNull(), "study_date_from_announcement_date")})


# First words and connectives that mark a name as a fragment.
FIRST_WORDS = (
    "the", "a", "an", "and", "or", "for", "its", "our", "their", "this", "that", "these", "those", "both", "each", "all", "it", "further", "updated", "revised", "resumption", "details", "reporting",
    "continues", "later", "regarding", "information", "following", "additional",
)
CONNECTIVES = ("the", "a", "an", "and", "or", "of", "at", "to", "in", "for", "as", "with", "by", "on", "from", "that", "this", "its", "our", "their", "it")


def is_fragment(name: Column) -> Column:
    """Whether a project's name is a fragment of an announcement: empty, in lower case, begun by a stop word, or joined by a connective."""
    n = F.trim(F.coalesce(name, F.lit("")))
    words = F.split(n, r"\s+")
    bare = lambda w: F.regexp_replace(w, r"^[.,:;]+|[.,:;]+$", "")
    later = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    first = bare(F.lower(F.get(words, F.lit(0)))).isin(*FIRST_WORDS) & ((F.size(words) == 1) | (F.size(words) >= 3))
    return (n == "") | n.rlike("^[a-z]") | first | F.exists(later, lambda w: bare(w).isin(*CONNECTIVES))


def name_rules(name: Column) -> dict[str, Column]:
    return {"prose": t.is_prose_name(name), "fragment": is_fragment(name), "screen": t.is_junk_name(name)}


def header_mismatch(header_tier: Column, tier: Column) -> Column:
    """Whether the headline names a more conceptual tier than the study's own."""
    rank = lambda x: F.when(x == "definitive", 0).when(x == "indicative", 1).when(x == "conceptual", 2)
    return F.coalesce(rank(header_tier) > F.coalesce(rank(tier), F.lit(9)), F.lit(False))


def validate_estimates(rows: DataFrame) -> DataFrame:
    """rows(document_id, row_no, commodity, category, tonnes, grade, grade_unit, contained, unit) of estimates: a row of warnings for each.

    The total against the sum of pure categories (5 %), skipped for several
    totals; grades out of the metal's range; contained metal off by 10 % from tonnes x grade.
    """
    total, pure = F.col("category") == "Total", F.col("category").isin(*f.PURE)
    low, high = v.lookup(F.col("commodity"), {m: a for m, (a, _) in GRADES.items()}), v.lookup(F.col("commodity"), {m: b for m, (_, b) in GRADES.items()})
    outlier = F.when(~total & ((F.col("grade") < low) | (F.col("grade") > high)), F.concat(F.lit("grade_outlier_"), "category"))
    expected = f.expected_contained(F.col("tonnes"), F.col("grade"), F.col("grade_unit"), F.col("unit"))
    off = F.when((expected != 0) & ~(F.col("contained") / expected).between(0.9, 1.1), F.concat(F.lit("contained_metal_mismatch_"), "category"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("row_no", c.alias("w"))))), lambda x: x["w"])
    d = rows.groupBy("document_id").agg(
        F.count_if(total).alias("totals"), F.max(F.when(total, F.col("tonnes"))).alias("total"), F.sum(F.when(pure, F.col("tonnes"))).alias("parts"), listed(outlier).alias("outliers"), listed(off).alias("off"),
    )
    gap = F.abs(F.col("total") - F.col("parts")) / F.col("parts")
    first = F.when(F.col("totals") > 1, "multiple_total_rows_tonnes_check_skipped").when((F.col("parts") > 0) & (gap > 0.05), F.concat(F.lit("total_tonnes_deviation_"), F.format_string("%.1f", F.bround(gap * 100, 1)), F.lit("%")))
    return d.select("document_id", F.concat(F.array_compact(F.array(first)), "outliers", "off").alias("warnings"))


def clean_reasons(reason: Column, doc_type: Column) -> Column:
    """The ;-separated reasons that apply to the type, or null."""
    parts = F.filter(F.transform(F.split(reason, ";"), lambda x: F.trim(x)), lambda x: x != "")
    drop = F.array().cast("array<string>")
    for kind, names in NOT_APPLICABLE.items():
        drop = F.when(doc_type == kind, F.array(*[F.lit(n) for n in names])).otherwise(drop)
    return F.nullif(F.array_join(F.filter(parts, lambda x: ~F.array_contains(drop, x)), "; "), F.lit(""))


def bad_quarter_ends(financials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows on a quarter's end, the others)."""
    ok = F.coalesce(F.date_format("effective_date", "MM-dd").isin(*QUARTER_ENDS), F.lit(False))
    return financials.where(ok), financials.where(~ok)


def repair_studies_and_revals(studies: DataFrame, revals: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Studies without future dates, and revaluations without those of conceptual or unknown tier of their own, or of a study stored as conceptual."""
    conceptual = studies.where("study_confidence_tier = 'conceptual'").select("study_id")
    kept = revals.where(F.coalesce(F.col("study_confidence_tier"), F.lit("conceptual")) != "conceptual").join(conceptual, "study_id", "left_anti")
    return studies.withColumn("study_date", discard_future_date(F.col("study_date"), as_of)), kept


def fabricated_legs(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(studies with two or more primary legs, legs of the other studies)."""
    odd = legs.where("is_primary").groupBy("study_id").count().where("count >= 2").select("study_id")
    return odd, legs.join(odd, "study_id", "left_anti")


def relabel_units(commodity: Column, unit: Column) -> Column:
    return F.when(commodity.isin("Pd", "Pt") & (unit == "t"), "oz").otherwise(unit)


def apply_overrides(financials: DataFrame, overrides: DataFrame, fields: tuple[str, ...], at: Column) -> DataFrame:
    """financials with the given fields replaced: overrides has financial_id and given (a map of field to value; a field given as null becomes null)."""
    d = financials.join(overrides.select("financial_id", "given"), "financial_id", "left")
    done = F.col("given").isNotNull()
    out = {c: F.when(done & F.map_contains_key("given", c), F.element_at("given", c)).otherwise(F.col(c)) for c in fields}
    return d.withColumns(out).withColumns({"needs_review": F.col("needs_review") & ~done, "reviewed_at": F.when(done, at)}).drop("given")


def string_nulls(df: DataFrame) -> DataFrame:
    """The words null, none and n/a in string columns become nulls."""
    return df.select(*[F.when(~F.lower(F.trim(c)).isin("null", "none", "n/a"), F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])
