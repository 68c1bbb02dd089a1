"""Operators on small inputs with known results, and readers and sinks on files."""

import datetime as dt
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from oreframe.functions import forms as ff
from oreframe.functions import text as t
from oreframe.functions import valuation as v
from oreframe.operators import company, entities, forms, prices, repairs, revaluation, screen, state
from oreframe.sources import facts, feeds, quarantine, stores

D = dt.date


def one(spark, **columns):
    r = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).collect()[0]
    return r if len(columns) > 1 else r[0]


@pytest.mark.parametrize("text,want", [("1,234", 1234.0), ("(5,000)", -5000.0), ("(5", None), ("5)", None), ("nil", None), ("-", None), ("", None), (" 7.5 ", 7.5), ("5f", None), ("1e3", 1000.0), ("-12", -12.0), ("abc", None)])
def test_parse_amount(spark, text, want):
    assert one(spark, x=t.parse_amount(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("A$133M", 133e6), ("C$2.7B", 2.7e9), ("$507.6 million", 507.6e6), ("$1.128 billion", 1.128e9), ("~$181m", 181e6), ("1,234,567", 1234567.0), ("x", None)])
def test_scaled_amount(spark, text, want):
    got = one(spark, x=t.scaled_amount(F.lit(text)))
    assert got == want or got == pytest.approx(want)


@pytest.mark.parametrize("header,want", [
    ("Corporate Presentation", "presentation"), ("Q1 highlights", "quarterly_activity"), ("Prefeasibility Study delivered", None), ("Scoping level feasibility study", None), ("Feasibility Study delivered", "study_dfs"),
    ("Pre-Feasibility Study", "study_pfs"), ("December Quarter", "quarterly_activity"), ("Investment Update", "quarterly_activity"), ("Appendix 5B", "appendix_5b"), ("Drilling", None), (None, None),
])
def test_headline_type(spark, header, want):
    assert one(spark, x=t.headline_type(F.lit(header).cast("string"))) == want


def test_scalars(spark):
    r = one(
        spark, a=v.annuity(F.lit(5.0), F.lit(10.0)), b=v.annuity(F.lit(8.0), F.lit(10.0)), c=v.annuity(F.lit(0.0), F.lit(10.0)), d=v.remaining_life(F.lit(10.0), F.lit(12.0)), e=v.remaining_life(F.lit(10.0), F.lit(-1.0)),
        f=v.copper_per_pound(F.lit(13000.0), F.lit("USD/lb")), g=v.copper_per_pound(F.lit(4.0), F.lit("USD / lb")), h=v.tax_rate(F.lit(0.3)), i=v.tax_rate(F.lit(0.0)), j=v.to_price_basis(F.lit(1.0), F.lit("Cu"), F.lit("t")),
        k=v.to_price_basis(F.lit(1.0), F.lit("Cu"), F.lit("lb")), l=v.to_price_basis(F.lit(1.0), F.lit("Au"), F.lit("t")), m=v.production_norm(F.lit(5.0), F.lit("Moz pa")), n=v.production_norm(F.lit(5.0), F.lit("widgets")),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (7.7217, 6.7101, None, 0.0, 10.0)
    assert r.f == pytest.approx(13000 / 2204.62262) and (r.g, r.h, r.i) == (4.0, 30.0, 0.0)
    assert (r.j, r.k, r.l, r.m, r.n) == (2204.62262, 1.0, None, 5e6, 5.0)


@pytest.mark.parametrize("unit,want", [("A$/oz", True), ("AUD/oz", True), ("$A per oz", True), ("US$/oz", False), ("CA$/oz", False), ("$AUD", True), ("USD", False), ("", False), (None, False)])
def test_aud_unit(spark, unit, want):
    assert one(spark, x=v.is_aud_unit(F.lit(unit).cast("string"))) is want


SINGLE = "commodity string, deck double, spot_price double, production double, production_unit string, mine_life_years double, elapsed double, discount_rate_pct double, tax_rate_pct double, npv double, reporting_currency string, fx_rate double"


def test_revalue_single(spark):
    rows = [
        ("Ag", 20.0, 30.0, 5e6, "oz", 10.0, None, 5.0, 30.0, 200.0, "USD", None), ("Au", 1900.0, 3500.0, 180e3, "oz", 10.0, None, 5.0, 30.0, 985.0, "AUD", 0.6452), ("Au", 1900.0, 3500.0, 180e3, "oz", 10.0, None, 5.0, 30.0, 985.0, "USD", None),
        ("Au", 1900.0, 3500.0, 180e3, "oz", 10.0, None, 5.0, 30.0, 985.0, "AUD", None), ("Zn", 1.0, 2.0, 1.0, "t", 10.0, None, 5.0, 30.0, 1.0, "USD", None), ("Au", 1.0, 2.0, 1.0, "t", 10.0, None, 5.0, 30.0, 1.0, "USD", None),
        ("Au", 1900.0, 3500.0, 180e3, "oz", 10.0, 11.0, 0.0, None, 985.0, "USD", None), ("Au", 1900.0, 3500.0, 180e3, "oz", 10.0, None, 0.0, None, 985.0, "USD", None),
    ]
    got = revaluation.revalue_single(spark.createDataFrame(rows, SINGLE)).collect()
    assert got[0].npv_spot == pytest.approx(470.26, abs=0.01) and got[0].npv_uplift_pct == pytest.approx(1.3513, abs=1e-4)
    assert got[1].npv_spot == pytest.approx(3397.74, abs=0.05) and got[1].npv_uplift == pytest.approx(2412.74, abs=0.05)
    assert got[2].npv_spot == pytest.approx(2541.70, abs=0.05)
    assert [g.error for g in got[3:6]] == ["fx_rate_required_for_aud_reporting", "unsupported_commodity:Zn", "Au_production_must_be_in_oz"]
    assert (got[6].error, got[6].npv_uplift, got[6].tax_used) == (None, 0.0, 30.0)
    assert got[7].error == "discount_rate_not_positive" and got[7].npv_spot is None


def _study(i, deck, npv=985.0, currency="AUD", stage="DFS", header=None, life=10.0, rate=5.0, project=1, tier=None):
    return Row(study_id=i, project_id=project, company_id=1, study_stage=stage, study_date=D(2024, 1, 1), header_tier=header, mine_life_years=life, discount_rate_pct=rate, tax_rate_pct=None, post_tax_npv=npv, reporting_currency=currency, assumed_price_deck=json.dumps(deck), needs_review=False, review_reason=None, study_confidence_tier=tier)


STUDY = "study_id long, project_id long, company_id long, study_stage string, study_date date, header_tier string, mine_life_years double, discount_rate_pct double, tax_rate_pct double, post_tax_npv double, reporting_currency string, assumed_price_deck string, needs_review boolean, review_reason string, study_confidence_tier string"
GOLD = [{"commodity": "Au", "price": 1900, "unit": "USD/oz"}]


@pytest.fixture(scope="module")
def prices_now(spark):
    rows = [("Au", 3520.0, 1), ("Ag", 75.0, 2), ("Cu", 4.5, 3), ("AUDUSD", 0.6452, 4)]
    return spark.createDataFrame(rows, "commodity string, price_usd double, price_id long")


def _run(spark, studies, legs, quotes, start=None, as_of=D(2024, 6, 1)):
    s = spark.createDataFrame(studies, STUDY)
    g = spark.createDataFrame(legs, "study_id long, leg int, commodity string, annual_production double, is_primary boolean")
    p = spark.createDataFrame([(1, "feasibility", start)], "project_id long, stage string, production_start_date date")
    gated = revaluation.gated(revaluation.priced_studies(s, g, quotes), p, F.lit(as_of))
    return {r.study_id: r for r in gated.collect()}, {r.study_id: r for r in revaluation.revalue_basket(gated, F.lit(as_of)).collect()}, revaluation.resolve_legs(s, g, quotes)


def test_basket(spark, prices_now):
    studies = [
        _study(1, GOLD), _study(2, [{"commodity": "Ag", "price": 30, "unit": "USD/oz"}], npv=200.0, currency="USD"), _study(3, [*GOLD, {"commodity": "Cu", "price": 9000, "unit": "USD/t"}, {"commodity": "Co", "price": 20, "unit": "USD/lb"}]),
        _study(4, [{"commodity": "Au", "price": 3000, "unit": "A$/oz"}], currency="USD"), _study(5, GOLD, header="conceptual"), _study(6, GOLD, stage="Scoping"), _study(7, GOLD, npv=None, life=None), _study(8, GOLD, currency="CAD"),
        _study(9, GOLD), _study(10, [{"commodity": "Pd", "price": 900, "unit": "USD/oz"}]), _study(11, [{"commodity": "Co", "price": 1, "unit": "x"}]), _study(12, GOLD, project=2), _study(13, GOLD, rate=0.0), _study(14, [*GOLD, {"commodity": "U3O8", "price": 50, "unit": "USD/lb"}]),
    ]
    legs = [
        (1, 1, "Au", 180e3, True), (2, 1, "Ag", 5.0, True), (3, 1, "Au", 180e3, True), (3, 2, "Cu", 20e3, False), (3, 3, "Co", 1000.0, False), (4, 1, "Au", 180e3, True), (5, 1, "Au", 180e3, True), (6, 1, "Au", 180e3, True), (7, 1, "Au", 1.0, True), (8, 1, "Au", 1.0, True),
        (10, 1, "Pd", 200e3, True), (11, 1, "Co", 1.0, True), (12, 1, "Au", 1.0, True), (13, 1, "Au", 180e3, True), (14, 1, "U3O8", 500.0, False), (14, 2, "Au", 2e6, True),
    ]
    gate, basket, resolved = _run(spark, studies, legs, prices_now)
    reasons = {i: r.reason for i, r in gate.items()}
    assert [reasons[i] for i in range(1, 5)] == [None] * 4
    assert reasons[5] == "not_revaluable_tier:conceptual_by_header" and reasons[6] == "not_revaluable_tier:conceptual" and reasons[7] == "missing_fields:mine_life_years,post_tax_npv"
    assert reasons[8] == "reporting_currency_not_supported:CAD" and reasons[9] == "no_study_commodities" and reasons[10] == "spot_missing:Pd" and reasons[11] == "not_revaluable_no_supported_commodity"
    assert reasons[12] == "study_not_found" and reasons[13] == "discount_rate_not_positive"
    assert reasons[14] == "u3o8_production_unit_ambiguous"  # the first leg in leg order, not in the alphabet
    assert basket[1].npv_spot == pytest.approx(3428.0, abs=1) and "tax_rate_defaulted_to_30.00pct" in basket[1].warnings
    assert basket[2].npv_spot == pytest.approx(1416.17, abs=1) and "production_magnitude_scaled_Ag_5_x1000000" in basket[2].warnings
    assert basket[3].coverage_pct < 100 and basket[3].n_supported == 2 and "cu_price_unit_t_to_lb:9000USD/t" in basket[3].warnings
    by_leg = {(r.study_id, r.leg): r for r in resolved.collect()}
    assert by_leg[3, 3].delta_revenue == 0 and by_leg[3, 3].deck_revenue > 0
    assert by_leg[4, 1].deck == pytest.approx(3000 * 0.6452) and "price_deck_aud_to_usd_Au:A$/oz" in basket[4].warnings
    # a single-leg basket is the single formula
    single = revaluation.revalue_single(spark.createDataFrame([("Au", 1900.0, 3520.0, 180e3, "oz", 10.0, None, 5.0, None, 985.0, "AUD", 0.6452)], SINGLE)).collect()[0]
    assert (single.npv_spot, single.npv_uplift_pct) == (basket[1].npv_spot, basket[1].npv_uplift_pct)


def test_basket_of_a_producer(spark, prices_now):
    _, new, _ = _run(spark, [_study(1, GOLD)], [(1, 1, "Au", 180e3, True)], prices_now)
    _, old, _ = _run(spark, [_study(1, GOLD)], [(1, 1, "Au", 180e3, True)], prices_now, start=D(2020, 6, 1))
    assert old[1].annuity < new[1].annuity and old[1].npv_uplift < new[1].npv_uplift
    _, gone, _ = _run(spark, [_study(1, GOLD)], [(1, 1, "Au", 180e3, True)], prices_now, start=D(2010, 1, 1))
    assert gone[1].npv_uplift == 0 and "mine_depleted_no_remaining_life" in gone[1].warnings
    no_fx, _, _ = _run(spark, [_study(1, GOLD), _study(2, [{"commodity": "Au", "price": 1, "unit": "A$/oz"}], currency="USD")], [(1, 1, "Au", 180e3, True), (2, 1, "Au", 180e3, True)], prices_now.where("commodity <> 'AUDUSD'"))
    assert {r.reason for r in no_fx.values()} == {"fx_missing:AUDUSD"}


def test_asof_and_rebase(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    left = spark.createDataFrame([("a", day(k), float(k)) for k in (1, 2, 3, 9)], "k string, at timestamp, x double")
    right = spark.createDataFrame([("a", day(2), 100.0), ("a", day(3), 110.0), ("b", day(1), 5.0)], "k string, at timestamp, y double")
    got = prices.asof_align(left, right, ["k"], "at", "y").orderBy("at").collect()
    assert [(r.x, r.y) for r in got] == [(2.0, 100.0), (3.0, 110.0), (9.0, 110.0)]
    series = spark.createDataFrame([("Au", D(2024, 1, 2), 50.0), ("Au", D(2024, 1, 1), 40.0)], "commodity string, day date, close double")
    assert sorted(r.rebased for r in prices.rebase(series).collect()) == [100.0, 125.0]
    assert prices.range_window(series, "6m", F.lit(D(2024, 1, 1))).count() == 1 and prices.range_window(series, "max", F.lit(D(2024, 1, 3))).collect()[0].close == 50.0


def test_screen_filters_and_order(spark):
    rows = [("A", "Alpha", 1, 1, "production", 1, ["Au"], ["Australia"], True, D(2024, 2, 1), 10.0, 13.9), ("B", "Beta", 3, 0, "feasibility", 4, ["Li"], ["Canada"], True, D(2020, 1, 1), 400.0, 4.35), ("C", None, 2, 2, None, None, [], [], False, None, None, None), ("D", "Delta", 1, 1, "production", 1, ["Cu"], [], True, None, 0.0, 0.0)]
    s = spark.createDataFrame(rows, "ticker string, company_name string, n_active int, n_with_study int, most_advanced string, rank int, commodities array<string>, countries array<string>, has_dfs_pfs boolean, latest_study_date date, npv_uplift double, npv_uplift_pct double")
    names = lambda df: [r.ticker for r in df.collect()]
    assert names(screen.rank_screen(s, "uplift_pct_desc")) == ["A", "B", "D", "C"] and names(screen.rank_screen(s, "uplift_abs_desc")) == ["B", "A", "D", "C"]
    assert names(screen.rank_screen(s)) == ["A", "D", "B", "C"] and names(screen.rank_screen(s, "project_count", 2)) == ["B", "C"]
    assert sorted(names(screen.screen_filter(s, single_project=True))) == ["A", "D"] and names(screen.screen_filter(s, stage="feasibility")) == ["B"] and names(screen.screen_filter(s, recent_since="2024-01-01")) == ["A"]
    every = {}
    for r in screen.rank_screens(s, 3).orderBy("sort", "place").collect():
        every.setdefault(r.sort, []).append(r.ticker)
    assert every == {sort: names(screen.rank_screen(s, sort, 3)) for sort in screen.SORTS}
    assert sorted(names(screen.screen_filter(s, supported_only=True))) == ["A", "D"] and names(screen.screen_filter(s, commodity="Li", country="Canada")) == ["B"]
    assert names(screen.visible(s, " ET ")) == ["B"] and sorted(names(screen.visible(s, hide_empty=True))) == ["A", "C", "D"]


def test_state(spark):
    existing = spark.createDataFrame([("a", "failed", "x"), ("b", "parsed", None), ("c", "skipped", "y"), ("d", "failed", "z")], "key string, parse_status string, parse_error string")
    incoming = spark.createDataFrame([("a",), ("b",), ("e",), ("e",)], "key string")
    got = {r.key: (r.parse_status, r.parse_error, r.is_new) for r in state.register_documents(existing, incoming).collect()}
    assert got == {"a": ("pending", None, True), "b": ("parsed", None, False), "c": ("skipped", "y", False), "d": ("failed", "z", False), "e": ("pending", None, True)}
    assert one(spark, a=state.content_key(F.lit("abc "), F.lit("u")), b=F.sha2(F.lit("ABC:u"), 256))[0] == one(spark, b=F.sha2(F.lit("ABC:u"), 256))


def test_merge_forks_is_idempotent(spark):
    p = spark.createDataFrame([(1, 1, "Syama", None, 1), (2, 1, "Syama Gold Project", None, 2), (3, 1, "Other", None, 3)], "project_id long, company_id long, project_name string, company_name string, created_at long")
    s = spark.createDataFrame([(1, 1, "DFS", 5.0), (2, 2, "DFS", 5.0), (3, 2, "DFS", None), (4, 2, "DFS", None), (5, 2, "PFS", 5.0), (6, 3, "DFS", 5.0), (7, 2, None, 1.0), (8, 2, None, 1.0), (9, 1, None, 1.0)], "study_id long, project_id long, study_stage string, post_tax_npv double")
    r = spark.createDataFrame([(1, 2, 2), (2, 5, 2), (3, 1, 1)], "revaluation_id long, study_id long, project_id long")
    c = spark.createDataFrame([(1, "Au", False), (2, "Au", True), (2, "Cu", True)], "project_id long, commodity string, is_primary boolean")
    e = spark.createDataFrame([(1, 2)], "resource_id long, project_id long")
    inferred = spark.createDataFrame([(1, 2, "exploration"), (2, 3, "development"), (3, 99, None)], "inference_id long, project_id long, inferred_stage string")
    out = entities.merge_forks(p, s, r, e, c, inferred)
    assert sorted((x.inference_id, x.project_id) for x in out["inferences"].collect()) == [(1, 1), (2, 3), (3, 99)]
    assert out["stats"].collect()[0].asDict() == {"groups_merged": 1, "projects_removed": 1, "studies_repointed": 4, "dup_studies_deleted": 2, "revals_deleted": 1}
    assert sorted((x.project_id, x.project_name) for x in out["projects"].collect()) == [(1, "Syama"), (3, "Other")]
    assert sorted((x.study_id, x.project_id) for x in out["studies"].collect()) == [(1, 1), (3, 1), (5, 1), (6, 3), (7, 1), (8, 1), (9, 1)]
    assert sorted((x.revaluation_id, x.project_id) for x in out["revaluations"].collect()) == [(2, 1), (3, 1)]
    assert sorted((x.project_id, x.commodity, x.is_primary) for x in out["commodities"].collect()) == [(1, "Au", False), (1, "Cu", True)]
    again = entities.merge_forks(out["projects"], out["studies"], out["revaluations"], out["resources"], out["commodities"], out["inferences"])
    assert set(again.pop("stats").collect()[0]) == {0} and out.pop("stats")
    incoming = spark.createDataFrame([(20, 1, "DFS", 5.0), (21, 1, "PFS", None), (22, 1, "PFS", None), (23, 1, None, 1.0), (24, 1, None, 1.0)], s.schema)
    assert sorted(x.study_id for x in entities.dedup_studies(s, incoming).collect()) == [21, 23, 24]
    assert {k: sorted(map(str, x.select(*sorted(x.columns)).collect())) for k, x in again.items()} == {k: sorted(map(str, x.select(*sorted(x.columns)).collect())) for k, x in out.items()}


@pytest.mark.parametrize("name,company_,want", [("Syama Gold Project", None, "Syama"), ("Gonneville PGE-Ni-Cu-Co-Au", None, "Gonneville"), ("Vulcan Zero Carbon Lithium", "Vulcan Energy", "Zero Carbon"), ("Gold Mine", None, "Gold"), ("Ra Hill", "Ra Ltd", "Ra Hill"), (" Hemi ", None, "Hemi"), ("Rebecca Underground", "X", "Rebecca Underground")])
def test_canonical_name(spark, name, company_, want):
    assert one(spark, x=entities.canonical_name(F.lit(name), F.lit(company_).cast("string"))) == want


def test_resource_rows_and_securities(spark):
    page = "Intro\nClass  Tonnes (Mt)  Grade (g/t)\nMeasured 1.5 2.0\nIndicated 3 1.0 9\nTotal 4.5 1.3\nInferred none"
    got = forms.resource_rows(spark.createDataFrame([(1, 1, page), (2, 1, "Measured 1\nprose")], "document_id long, page_no int, text string")).orderBy("line_no").collect()
    assert [(r.label, r.cells, r.headers) for r in got] == [("Measured", ["1.5", "2.0"], ["Class", "Tonnes (Mt)", "Grade (g/t)"]), ("Indicated", ["3", "1.0"], got[0].headers), ("Total", ["4.5", "1.3"], got[0].headers)]
    part = "4.1 Quoted +securities\nABC : ORDINARY FULLY PAID 1,000\nABCO : OPTION EXPIRING 07-OCT-2028 50\n4.2 Unquoted +securities\nABCAA : OPTION EXPIRING 31-FEB-2027 EX $1.50 20\nABCAC : CONVERTIBLE NOTES 7\nABCAD : CLASS B 3"
    rows = forms.security_rows(spark.createDataFrame([(1, part)], "document_id long, section string"))
    assert [(r.code, r.kind, r.total_on_issue, r.warning) for r in rows.orderBy(F.desc("quoted"), "line_no").collect()] == [("ABC", "share", 1000, None), ("ABCO", "option", 50, None), ("ABCAA", "option", 20, "option_unparsed_expiry"), ("ABCAC", "convertible_note", 7, None), ("ABCAD", "other", 3, "unquoted_row_unparsed")]
    assert forms.capital_totals(rows).collect()[0].asDict() == {"document_id": 1, "shares_basic": 1000, "shares_fd": 1080, "options_outstanding": 70, "convertible_notes": 7, "performance_rights": 0, "status": "ok"}
    assert one(spark, x=ff.cdi_shares(F.lit("CHESS DEPOSITARY INTERESTS 10:1"), F.lit(1000.0))) == 100.0


def test_estimate_validation(spark):
    rows = [(1, 1, "Au", "Measured", 1.0, 1.0, "g/t", 32.15, "koz"), (1, 2, "Au", "Total", 2.0, 200.0, "g/t", None, None), (2, 1, "Au", "Indicated", 1.0, 500.0, "g/t", 5.0, "koz"), (3, 1, "Xx", None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "document_id long, row_no int, commodity string, category string, tonnes double, grade double, grade_unit string, contained double, unit string")
    got = {r.document_id: r.warnings for r in repairs.validate_estimates(d).collect()}
    assert got == {1: ["total_tonnes_deviation_100.0%"], 2: ["grade_outlier_Indicated", "contained_metal_mismatch_Indicated"], 3: []}


def test_readers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿PROJECT_NAME,Operator,COMMODITY,Status\nHill Mine, Op Ltd ,Au; Cu,PFS\n,x,,\n", encoding="utf-8")
    got = feeds.read_deposits_csv(spark, str(tmp_path / "d.csv")).collect()
    assert [(r.deposit_name, r.operator_name, r.commodities, r.state, r.operating_status) for r in got] == [("Hill Mine", "Op Ltd", "Au; Cu", "", "PFS"), ("", "x", "", "", "")]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"name": "N", "OPERATOR": "O", "STATE": "WA"}}, {"properties": None}]}, indent=1))
    assert [(r.deposit_name, r.operator_name, r.state) for r in feeds.read_deposits_geojson(spark, str(tmp_path / "g.json")).collect()] == [("N", "O", "WA"), ("", "", "")]
    (tmp_path / "t.txt").write_text("# gold\nABC\n\n XYZ \n")
    assert [r.ticker for r in feeds.read_ticker_list(spark, str(tmp_path / "t.txt")).collect()] == ["ABC", "XYZ"]
    (tmp_path / "l.csv").write_text("operator,ticker\n Big Op ,abc\n")
    assert [tuple(r) for r in feeds.read_lookup_csv(spark, str(tmp_path / "l.csv"), "operator", ("ticker",)).collect()] == [("big op", "ABC")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1, D(2024, 1, 1)), (1, "b", 2, D(2024, 1, 1)), (2, "c", 1, D(2023, 1, 1))], "document_id long, x string, created_at int, effective_date date")
    path = str(tmp_path / "staging")
    stores.write_staging(rows.where("x <> 'b'"), path, ["document_id"], [F.desc("created_at")])
    stores.write_staging(rows.where("x = 'b'"), path, ["document_id"], [F.desc("created_at")])
    assert sorted((r.document_id, r.x) for r in stores.read_staging(spark, path, ["document_id"]).collect()) == [(1, "b"), (2, "c")]
    facts = str(tmp_path / "facts")
    stores.append_snapshots(rows.where("x = 'c'"), rows.limit(0), facts)
    stores.append_snapshots(rows.where("x <> 'a'"), spark.read.parquet(facts), facts)
    assert sorted((r.x, r.year) for r in spark.read.parquet(facts).collect()) == [("b", 2024), ("c", 2023)]


def test_stream(spark, tmp_path):
    from oreframe.streaming import filings

    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    folder.mkdir()
    line = lambda u: json.dumps({"ticker": "abc", "url": u, "announced_at": "2024-01-01T00:00:00Z"}) + "\n"
    (folder / "1.json").write_text(line("u1") + line("u1") + line("u2"))
    run = lambda: filings.register_stream(filings.new_filings(spark, str(folder), "ticker string, url string, announced_at timestamp"), table, checkpoint).awaitTermination(120)
    run()
    assert filings.registry(spark, table).read().count() == 2
    (folder / "2.json").write_text(line("u2") + line("u3"))
    run()
    assert sorted(r.parse_status for r in filings.registry(spark, table).read().collect()) == ["pending"] * 3


def test_activity_and_runway(spark):
    f = spark.createDataFrame([(1, "A", "appendix_5b", "h", D(2024, 1, 1), "parsed"), (2, "A", "other", None, None, "parsed"), (3, "A", "other", "text", None, "parsed"), (4, "A", "other", "x", D(2024, 1, 2), "failed")], "document_id long, ticker string, doc_type string, header string, announcement_date date, parse_status string")
    c = spark.createDataFrame([(1, 1, D(2024, 1, 1), 10.0, -5.0, None)], "financial_id long, document_id long, effective_date date, cash double, burn double, shares_fd double")
    got = {r.document_id: (r.label, r.detail) for r in company.activity_feed(f, c).collect()}
    assert got == {1: ("Quarterly update", "cash 10. inflow 5"), 3: ("Announcement", "text")}
    r = one(spark, a=v.runway_label(F.lit(10.0), F.lit(4.0)), b=v.runway_label(F.lit(10.0), F.lit(-4.0)), c=v.runway_label(F.lit(10.0), F.lit(0.0)))
    assert tuple(r) == ("~2 quarters of runway", "Net cash positive", None)


def test_stored_tier_against_stage(spark, prices_now):
    """The gate and the refresh fall back on the stage of rows without a tier; other readers take the stored tier."""
    studies = [_study(1, GOLD, stage="DFS", tier="conceptual"), _study(2, GOLD, stage="Scoping", tier="definitive"), _study(3, GOLD, stage="DFS"), _study(4, GOLD, stage="PEA")]
    gate, basket, _ = _run(spark, studies, [(i, 1, "Au", 180e3, True) for i in range(1, 5)], prices_now)
    assert [gate[i].reason for i in range(1, 5)] == ["not_revaluable_tier:conceptual", None, None, "not_revaluable_tier:conceptual"]
    rows = revaluation.revaluation_rows(revaluation.revalue_basket(revaluation.gated(revaluation.priced_studies(spark.createDataFrame(studies, STUDY), spark.createDataFrame([(2, 1, "Au", 1.0, True), (3, 1, "Au", 1.0, True)], "study_id long, leg int, commodity string, annual_production double, is_primary boolean"), prices_now), spark.createDataFrame([(1, "feasibility", None, 1, "Au")], "project_id long, stage string, production_start_date date, n_commodities int, primary_commodity string"), F.lit(D(2024, 6, 1))), F.lit(D(2024, 6, 1))))
    assert {r.study_id: r.study_confidence_tier for r in rows.collect()} == {2: "definitive", 3: None}
    s = spark.createDataFrame(studies, STUDY)
    none = spark.createDataFrame([], "study_id long")
    companies = spark.createDataFrame([(1, "ABC")], "company_id long, ticker string")
    assert [r.study_id for r in revaluation.backfill_candidates(s, none, companies).collect()] == [2]
    runs = spark.createDataFrame([(i, dt.datetime(2024, 1, i)) for i in range(1, 5)], "study_id long, computed_at timestamp")
    apart = s.withColumn("project_id", F.col("study_id"))
    assert sorted(r.study_id for r in revaluation.stale_revaluations(apart, runs, F.lit("2024-06-01").cast("timestamp")).collect()) == [2, 3]
    assert revaluation.sweep_stats(spark.createDataFrame([(None,), ("missing_fields:x",), ("not_revaluable_tier:x",)], "reason string")).collect()[0].asDict() == {"total": 3, "refreshed": 1, "skipped": 0, "errors": 2}


def test_facts_lie_together(spark, tmp_path):
    """Tables of one key join and aggregate without a shuffle, and are written again when their source changes."""
    source = str(tmp_path / "source.parquet")
    spark.range(1000).select((F.col("id") % 100).alias("study_id"), "id").write.parquet(source)
    load = lambda: facts.loaded(spark, "legs", [source], "study_id", lambda: spark.read.parquet(source), 4)
    legs, studies = load(), facts.loaded(spark, "studies", [source], "study_id", lambda: spark.read.parquet(source).select("study_id").distinct(), 4)
    assert load().inputFiles() == legs.inputFiles() and len(legs.inputFiles()) == 4
    both = studies.join(legs.hint("merge"), "study_id").groupBy("study_id").count()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {r["count"] for r in both.collect()} == {10}
    spark.range(5).select(F.col("id").alias("study_id"), "id").write.mode("append").parquet(source)
    assert load().count() == 1005 and sorted(load().inputFiles()) != sorted(legs.inputFiles())


def test_quarantine(spark, tmp_path):
    (tmp_path / "d.csv").write_text("name,Operator,COMMODITY\nHill Mine,Op,Au\nshort,x\n,Op,Cu\nlong,a,b,c,d\n\"Big, Mine\",Op,Ni\n")
    good, rejects = quarantine.read_deposits_csv(spark, str(tmp_path / "d.csv"))
    assert sorted(r.deposit_name for r in good.collect()) == ["Big, Mine", "Hill Mine"]
    assert sorted((r.reason, r.record) for r in rejects.collect() if r.reason == "malformed") == [("malformed", "long,a,b,c,d"), ("malformed", "short,x")]
    assert [r.reason for r in rejects.collect()].count("no_name") == 1
    news = spark.createDataFrame([(1, '{"data":{"items":[{"headline":"H","documentKey":"k","date":"2024-01-02T"},{"headline":null},{"headline":"x","documentKey":"k","date":"2024-13-45"}]}}'), (2, "{"), (3, None), (4, "{}"), (5, "[1]")], "id long, payload string")
    good, rejects = quarantine.announcements(news, "id")
    assert [tuple(r) for r in good.collect()] == [(1, "H", "https://documents/k", "2024-01-02")]
    assert sorted((r.id, r.place, r.reason) for r in rejects.collect() if r.id == 1) == [(1, 1, "no_headline"), (1, 2, "bad_date")]
    assert {r.id: r.reason for r in rejects.collect() if r.id > 1} == {2: "not_json", 3: "not_json", 4: "no_items", 5: "not_json"}
    assert next(r.record for r in rejects.collect() if r.id == 2) == "{"


def test_naming_filings(spark):
    names = ["Granite Hill", "granite", "Ra", "x", "", None, "Hill 3", "nite H", "Zinc Hill", "é", "GRANITE HILL 3 d"]
    projects = spark.createDataFrame([(i, "AB"[i % 2], n) for i, n in enumerate(names * 2)], "project_id long, ticker string, project_name string")
    heads = ["Granite Hill 3 drilling", "granite hills", "RA", "", None, "Près de x", "Hill 3 and hill 3", "zinc hil"]
    filings_ = spark.createDataFrame([(j, "ABB"[j % 3], h, j * 2) for j, h in enumerate(heads * 3)], "document_id long, ticker string, header string, n int")
    got = sorted(tuple(r) for r in entities.naming_filings(projects, filings_, "n").collect())
    p, f = projects.collect(), filings_.collect()
    assert got == sorted((a.project_id, b.document_id, b.n) for a in p for b in f if a.ticker == b.ticker and a.project_name is not None and b.header is not None and a.project_name.lower() in b.header.lower())
    assert len(got) > 30
