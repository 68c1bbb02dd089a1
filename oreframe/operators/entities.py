"""Normalisation into financial snapshots, and resolution of projects, operators, legs and stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import valuation as v
from . import repairs
from .common import top

# Trailing words and symbols that aren't part of a project's name.
SYMBOL = "(?:PGE|Ni|Cu|Co|Au|Ag|Zn|Pb|Li|Sn|U|REE|Fe)"
CHAIN = rf"(?i)\s+{SYMBOL}(?:\s*[-–/]\s*{SYMBOL})+\s*$"
QUALIFIER = r"(?i)\s+(?:Project|Deposit|Mine|Operations?|Limited|Ltd|Gold|Copper|Lithium|Nickel|Silver|Zinc|Uranium|Cobalt|Graphite|Iron\s*Ore|Iron|Rare\s*Earths?)\s*$"
COMPANY_SUFFIX = r"\s+(?:limited|ltd\.?|pty|plc|corp|corporation|inc|n\.?l\.?)\s*$"
RECEIPTS_FLOOR, RECEIPTS_MAX = 1_000_000.0, 5_000_000_000.0
FIELDS = ("cash", "debt", "burn", "invest_burn", "receipts", "shares_basic", "shares_fd", "options_outstanding", "perf_rights", "convertibles")


def _snapshots(staged: DataFrame, docs: DataFrame, date: Column, **values: Column) -> DataFrame:
    """Staged rows as snapshots of the documents' companies; fields that the kind of filing doesn't give are null."""
    d = staged.join(docs.select("document_id", "ticker", "announcement_date"), "document_id").withColumn("effective_date", date)
    fields = [values.get(c, F.lit(None)).cast("double").alias(c) for c in FIELDS]
    return d.select("document_id", "ticker", "effective_date", F.coalesce("announcement_date", "effective_date").alias("announcement_date"), *fields)


def financials_from_cashflow(staged: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots, refused documents with the reason): of cash flow forms; without a date there is none. Receipts come from the raw JSON."""
    receipts = F.try_variant_get(F.try_parse_json("raw_json"), "$.receipts_from_customers", "double")
    dated = staged.where("effective_date is not null")
    out = _snapshots(dated.withColumn("_date", F.col("effective_date")).drop("effective_date"), docs, F.col("_date"), cash=F.col("cash"), debt=F.col("debt"), burn=F.col("quarterly_opex_burn"), invest_burn=F.col("quarterly_invest_burn"), receipts=receipts)
    return out, staged.where("effective_date is null").select("document_id", F.lit("normalize_blocked:missing_effective_date").alias("parse_error"))


def diluted(basic: Column, options: Column, rights: Column) -> Column:
    return basic + F.coalesce(options, F.lit(0.0)) + F.coalesce(rights, F.lit(0.0))


def financials_from_securities(staged: DataFrame, docs: DataFrame) -> DataFrame:
    """Snapshots of forms on securities: document_id, effective_date (may be null), total_shares, total_options, total_rights."""
    shares, options, rights = F.col("total_shares"), F.col("total_options"), F.col("total_rights")
    d = staged.withColumnRenamed("effective_date", "_date")
    return _snapshots(d, docs, F.coalesce("_date", "announcement_date"), shares_basic=shares, shares_fd=diluted(shares, options, rights), options_outstanding=options, perf_rights=rights)


def financials_from_presentation(staged: DataFrame, docs: DataFrame) -> DataFrame:
    """Snapshots of presentations; the diluted count is computed only where it isn't given."""
    basic, options, rights = F.col("shares_basic"), F.col("options_outstanding"), F.col("perf_rights_outstanding")
    d = staged.withColumnRenamed("effective_date", "_date")
    return _snapshots(d, docs, F.coalesce("_date", "announcement_date"), cash=F.col("cash"), debt=F.col("debt"), shares_basic=basic, shares_fd=F.coalesce("shares_fd", diluted(basic, options, rights)), options_outstanding=options, perf_rights=rights)


def financials_from_capital(totals: DataFrame, rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(snapshots, capital snapshots, unquoted instruments) of parsed totals and their rows; documents without quoted shares give none."""
    good = totals.where("status = 'ok'")
    snapshots = _snapshots(good, docs, F.col("announcement_date"), shares_basic=F.col("shares_basic"), shares_fd=F.col("shares_fd"), options_outstanding=F.col("options_outstanding"), perf_rights=F.col("performance_rights"), convertibles=F.col("convertible_notes"))
    capital = good.join(docs.select("document_id", "ticker", F.col("announcement_date").alias("snapshot_date")), "document_id").drop("status")
    instruments = rows.where("kind <> 'share'").join(good.select("document_id"), "document_id", "left_semi")
    return snapshots, capital, instruments.select("document_id", "code", F.col("kind").alias("instrument_type"), "description", "total_on_issue", "expiry_date", "strike")


def canonical_name(name: Column, company: Column) -> Column:
    """A project's name without the company's first word, trailing metal symbols, and up to three trailing qualifiers."""
    word = F.get(F.split(F.trim(F.coalesce(company, F.lit(""))), r"\s+"), F.lit(0))
    rest = F.regexp_replace(F.substring(name, F.length(word) + 1, F.length(name)), r"^\s+", "")
    starts = (F.length(word) >= 3) & F.lower(name).startswith(F.lower(word)) & F.substring(name, F.length(word) + 1, F.lit(1)).rlike(r"^\s$") & (rest != "")
    x = F.when(starts, rest).otherwise(name)
    x = F.coalesce(F.nullif(F.trim(F.regexp_replace(x, CHAIN, "")), F.lit("")), x)
    for _ in range(3):
        x = F.trim(F.regexp_replace(x, QUALIFIER, ""))
    return F.coalesce(F.nullif(x, F.lit("")), F.trim(name))


def resolve_projects(mentions: DataFrame, projects: DataFrame) -> DataFrame:
    """The project of each mention: mention_id, project_id (null for one to create), canonical, outcome.

    mentions has mention_id, company_id, project_name and company_name, projects has
    project_id, company_id, project_name, company_name and created_at. A mention matches the
    newest project of the same canonical name; a fragment goes to the company's newest real
    project; the rest are to be created, one project for each company and canonical name.
    """
    key = lambda d: d.withColumn("canonical", canonical_name(F.col("project_name"), F.col("company_name"))).withColumn("k", F.lower("canonical"))
    newest = [F.desc_nulls_last("created_at"), F.desc("project_id")]
    have = top(key(projects), ["company_id", "k"], newest).select("company_id", "k", F.col("project_id").alias("matched"))
    real = top(projects.where(~repairs.is_fragment(F.col("project_name"))), ["company_id"], newest).select("company_id", F.col("project_id").alias("fallback"))
    m = key(mentions).join(have, ["company_id", "k"], "left").join(real, "company_id", "left")
    junk = repairs.is_fragment(F.col("canonical"))
    outcome = F.when(F.col("matched").isNotNull(), "matched").when(junk & F.col("fallback").isNotNull(), "attached").otherwise("created")
    return m.select("mention_id", "company_id", F.coalesce("matched", F.when(junk, F.col("fallback"))).alias("project_id"), "canonical", outcome.alias("outcome"))


def merge_forks(projects: DataFrame, studies: DataFrame, revals: DataFrame, resources: DataFrame, commodities: DataFrame, inferences: DataFrame) -> dict[str, DataFrame]:
    """Projects of one company and canonical name as one, that of the smallest id, with all that refers to them.

    projects has company_name. Studies of the same stage and value are one, the keeper's own before
    others, then by id; the keeper's own all stay. Null values are equal, but a null stage equals none, so studies
    without a stage all stay. Revaluations of dropped studies go. Commodities are kept once a project, and
    inferences (project_id, ...) follow their project. stats tells in one row what was done.
    """
    p = projects.withColumn("canonical", canonical_name(F.col("project_name"), F.col("company_name")))
    group = W.partitionBy("company_id", F.lower("canonical"))
    cross = p.withColumn("keeper", F.min("project_id").over(group)).select("project_id", "keeper", "canonical", F.count("*").over(group).alias("size"))
    moved = lambda d: d.withColumnRenamed("project_id", "_from").join(cross.select(F.col("project_id").alias("_from"), "keeper"), "_from", "left").withColumns({"own": F.coalesce(F.col("_from") == F.col("keeper"), F.lit(True)), "project_id": F.coalesce("keeper", "_from")}).drop("keeper")
    same = W.partitionBy("project_id", "study_stage", "post_tax_npv").orderBy(F.desc("own"), "study_id")
    s = moved(studies).withColumn("keep", F.col("own") | F.col("study_stage").isNull() | (F.row_number().over(same) == 1))
    gone = s.where("not keep").select("study_id")
    stats = cross.agg(F.count_if((F.col("project_id") == F.col("keeper")) & (F.col("size") > 1)).alias("groups_merged"), F.count_if(F.col("project_id") != F.col("keeper")).alias("projects_removed"))
    stats = stats.withColumns({
        "studies_repointed": s.where("keep and not own").agg(F.count("*")).scalar(), "dup_studies_deleted": gone.agg(F.count("*")).scalar(),
        "revals_deleted": revals.join(gone, "study_id", "left_semi").agg(F.count("*")).scalar(),
    })
    keepers = p.join(cross.select("project_id", "keeper", "size"), "project_id").where("project_id = keeper")
    return {
        "projects": keepers.withColumn("project_name", F.when(F.col("size") > 1, F.col("canonical")).otherwise(F.col("project_name"))).drop("canonical", "keeper", "size"),
        "studies": s.where("keep").drop("own", "keep", "_from"), "revaluations": moved(revals).drop("own", "_from").join(gone, "study_id", "left_anti"), "resources": moved(resources).drop("own", "_from"),
        "inferences": moved(inferences).drop("own", "_from"), "stats": stats,
        "commodities": moved(commodities).groupBy("project_id", "commodity").agg(F.max_by("is_primary", F.struct("own", -F.col("_from"))).alias("is_primary")),
    }


def study_legs(studies: DataFrame) -> DataFrame:
    """A leg for each valid metal of studies(study_id, primary_commodity, annual_production, annual_production_unit, basket array<struct<commodity, annual_production, unit>>).

    The primary metal takes the study's own normalised production; without a valid basket it is the only leg.
    """
    valid = lambda c: F.coalesce(~F.lower(F.trim(c)).isin("null", "none", "n/a", ""), F.lit(False))
    own = v.production_norm(F.col("annual_production"), F.col("annual_production_unit"))
    d = studies.withColumns({"own": own, "legs": F.filter(F.coalesce("basket", F.array().cast("array<struct<commodity:string,annual_production:double,unit:string>>")), lambda x: valid(x["commodity"]))})
    listed = d.select("study_id", "primary_commodity", "own", F.posexplode("legs").alias("leg", "x")).select("study_id", "leg", F.col("x.commodity").alias("commodity"), "own", (F.col("x.commodity") == F.col("primary_commodity")).alias("is_primary"), v.production_norm(F.col("x.annual_production"), F.col("x.unit")).alias("norm"))
    listed = listed.select("study_id", "leg", "commodity", F.when(F.coalesce("is_primary", F.lit(False)), F.col("own")).otherwise(F.col("norm")).alias("annual_production"), F.coalesce("is_primary", F.lit(False)).alias("is_primary"))
    alone = d.where((F.size("legs") == 0) & valid(F.col("primary_commodity"))).select("study_id", F.lit(0).alias("leg"), F.col("primary_commodity").alias("commodity"), F.col("own").alias("annual_production"), F.lit(True).alias("is_primary"))
    return listed.unionByName(alone).withColumn("unit", v.basis_unit(F.col("commodity")))


def backfill_legs(studies: DataFrame, project_commodities: DataFrame, legs: DataFrame) -> DataFrame:
    """A leg for each study without any whose project has exactly one primary metal."""
    one = project_commodities.where("is_primary").groupBy("project_id").agg(F.count("*").alias("n"), F.min("commodity").alias("commodity")).where("n = 1").drop("n")
    return studies.join(legs.select("study_id"), "study_id", "left_anti").join(one, "project_id").select("study_id", "commodity", "annual_production", F.lit(True).alias("is_primary"))


def dedup_studies(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming studies whose project, stage and value aren't there yet, each once. Null values are equal, but a null stage equals none: such studies all come in."""
    e = existing.select("project_id", "study_stage", F.col("post_tax_npv").alias("_npv")).alias("e")
    staged = top(incoming.where("study_stage is not null"), ["project_id", "study_stage", "post_tax_npv"], [F.col("study_id")])
    i = staged.unionByName(incoming.where("study_stage is null")).alias("i")
    return i.join(e, (F.col("i.project_id") == F.col("e.project_id")) & (F.col("i.study_stage") == F.col("e.study_stage")) & F.col("i.post_tax_npv").eqNullSafe(F.col("e._npv")), "left_anti")


def operator_key(name: Column) -> Column:
    n = F.trim(F.regexp_replace(F.lower(F.trim(name)), COMPANY_SUFFIX, ""))
    return F.regexp_replace(n, r"\s+", " ")


def match_operators(deposits: DataFrame, mapping: DataFrame, companies: DataFrame) -> DataFrame:
    """deposits with company_id and an outcome: matched, skipped_unmapped or skipped_no_company. mapping has operator and ticker."""
    d = deposits.withColumn("operator", operator_key(F.col("operator_name"))).join(mapping.select("operator", "ticker"), "operator", "left").join(companies.select("ticker", "company_id"), "ticker", "left")
    usable = (F.trim("deposit_name") != "") & (F.trim("operator_name") != "") & F.col("ticker").isNotNull()
    return d.withColumn("outcome", F.when(~F.coalesce(usable, F.lit(False)), "skipped_unmapped").when(F.col("company_id").isNull(), "skipped_no_company").otherwise("matched"))


def normalize_stage(status: Column) -> Column:
    return v.lookup(F.lower(F.trim(status)), v.REGISTRY_STAGES)


def split_commodities(df: DataFrame, raw: str) -> DataFrame:
    """A row for each metal of a list separated by commas, semicolons or slashes; the first is primary."""
    parts = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[,;/]"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(*df.columns, F.posexplode(parts).alias("place", "metal")).withColumn("is_primary", F.col("place") == 0)


def fill_null_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """existing with nulls filled from incoming (unique by keys), and incoming's new rows; outcome tells inserted, updated, unchanged."""
    e = existing.select(*keys, *[F.col(c).alias(f"e_{c}") for c in fields], F.lit(True).alias("known"))
    i = incoming.select(*keys, *[F.col(c).alias(f"i_{c}") for c in fields], F.lit(True).alias("came"))
    filled = F.greatest(*[(F.col(f"e_{c}").isNull() & F.col(f"i_{c}").isNotNull()).cast("int") for c in fields], F.lit(0)) == 1
    outcome = F.when(F.col("known").isNull(), "inserted").when(F.col("came") & filled, "updated").otherwise("unchanged")
    return e.join(i, keys, "full").select(*keys, *[F.coalesce(f"e_{c}", f"i_{c}").alias(c) for c in fields], outcome.alias("outcome"))


def load_stats(matched: DataFrame, upserted: DataFrame) -> DataFrame:
    """Counts of a load in one row."""
    o = F.col("outcome")
    a = matched.agg(F.count("*").alias("fetched"), F.count_if(o == "matched").alias("matched"), F.count_if(o == "skipped_unmapped").alias("skipped_unmapped"), F.count_if(o == "skipped_no_company").alias("skipped_no_company"), F.lit(1).alias("_one"))
    b = upserted.agg(F.count_if(o == "inserted").alias("inserted"), F.count_if(o == "updated").alias("updated"), F.lit(1).alias("_one"))
    return a.join(b, "_one").drop("_one")


def resources_from_estimates(rows: DataFrame, keep_totals: bool = True) -> DataFrame:
    """Resource rows of resolved estimates; totals are kept unless told otherwise."""
    kept = rows if keep_totals else rows.where("category <> 'Total'")
    return kept.select("project_id", "document_id", "effective_date", "commodity", "category", "tonnes", "grade", "grade_unit", F.col("contained").alias("contained_metal"), F.col("unit").alias("contained_metal_unit"))


def best_tier(studies: DataFrame) -> DataFrame:
    rank = F.min(F.when(F.col("tier") == "definitive", 0).when(F.col("tier") == "indicative", 1).when(F.col("tier") == "conceptual", 2))
    return studies.groupBy("project_id").agg(rank.alias("best"))


def stage_worklist(projects: DataFrame, companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Projects whose company has a filing newer than the project's watermark (last_classified_doc_id)."""
    newest = filings.groupBy("ticker").agg(F.max("document_id").alias("newest"))
    d = projects.join(companies.select("company_id", "ticker"), "company_id").join(newest, "ticker")
    return d.where(F.col("newest") > F.coalesce("last_classified_doc_id", F.lit(0))).select("project_id", "ticker", "newest")


def _first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str, *columns: str) -> DataFrame:
    """One row per key with its first k rows as an array of structs in order."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", *columns))), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))


GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """The distinct runs of n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))


def naming_filings(projects: DataFrame, filings: DataFrame, *columns: str) -> DataFrame:
    """(project_id, document_id, columns) of filings whose header holds the project's name, whatever the case, of the same ticker.

    projects has project_id, ticker and project_name, filings has ticker, document_id, header and
    columns. An index of the headers' runs of three characters (all of a shorter name) gives
    the filings that hold a name's rarest run; these alone are compared, so neither a
    ticker's projects nor its filings are multiplied. Empty names are in every header of their ticker.
    """
    names = projects.select("project_id", "ticker", F.lower("project_name").alias("name")).where("name is not null")
    heads = filings.select("ticker", "document_id", F.lower("header").alias("head"), *columns).where("head is not null")
    sizes = F.array(*[F.lit(k) for k in range(1, GRAM + 1)])
    lengths = F.filter(sizes, lambda k: k <= F.length("head"))
    index = heads.select("ticker", "document_id", F.explode(F.flatten(F.transform(lengths, lambda k: _grams(F.col("head"), k)))).alias("gram"))
    n = F.least(F.length("name"), F.lit(GRAM))
    wanted = names.where("name <> ''").select("project_id", "ticker", F.explode(_grams(F.col("name"), n)).alias("gram"))
    # runs that no header has keep a count of 0, and so rule their name out
    often = index.join(wanted.select("ticker", "gram").distinct(), ["ticker", "gram"], "left_semi").groupBy("ticker", "gram").count()
    rarest = wanted.join(often, ["ticker", "gram"], "left").groupBy("project_id", "ticker").agg(F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)), "gram")).alias("gram"))
    maybe = rarest.join(index, ["ticker", "gram"]).select("project_id", "document_id")
    checked = maybe.join(names.select("project_id", "name"), "project_id").join(heads.drop("ticker"), "document_id").where(F.contains("head", "name"))
    everywhere = names.where("name = ''").join(heads, "ticker")
    return checked.select("project_id", "document_id", *columns).unionByName(everywhere.select("project_id", "document_id", *columns))


def stage_evidence(projects: DataFrame, companies: DataFrame, studies: DataFrame, resources: DataFrame, filings: DataFrame, as_of: Column) -> DataFrame:
    """What tells a project's stage: its latest 3 studies and 3 resource rows, and 6 announcements of 180 days that name it, else any 6 of the company's of 90 days."""
    p = projects.select("project_id", "company_id", "project_name").join(companies.select("company_id", "ticker"), "company_id")
    recent = filings.where((F.col("announcement_date") <= as_of) & (F.col("announcement_date") >= F.date_sub(as_of, 180))).select("ticker", "document_id", "header", "announcement_date")
    newest = [F.desc("announcement_date"), F.desc("document_id")]
    named = naming_filings(p, recent, "announcement_date")
    any_ = _first_k(recent.where(F.col("announcement_date") >= F.date_sub(as_of, 90)), ["ticker"], newest, 6, "any_announcements", "document_id")
    s = _first_k(studies, ["project_id"], [F.desc_nulls_last(F.coalesce("study_date", "announcement_date")), F.desc("study_id")], 3, "studies", "study_id", "study_stage")
    r = _first_k(resources, ["project_id"], [F.desc_nulls_last("effective_date"), F.desc("resource_id")], 3, "resources", "resource_id", "commodity")
    d = p.join(s, "project_id", "left").join(r, "project_id", "left").join(_first_k(named, ["project_id"], newest, 6, "named", "document_id"), "project_id", "left").join(any_, "ticker", "left")
    return d.select("project_id", "studies", "resources", F.coalesce("named", "any_announcements").alias("announcements"))


def production_floor(projects: DataFrame, financials: DataFrame, studies: DataFrame, as_of: Column) -> DataFrame:
    """Projects with the stage that a production signal gives: a first production that has passed, with a study stored as definitive or indicative; or the company's latest receipts within bounds, which promote its most advanced project (ties: smallest id)."""
    revaluable = studies.where(v.revaluable(F.col("study_confidence_tier"))).select("project_id").distinct().withColumn("revaluable", F.lit(True))
    latest = top(financials.where("receipts is not null"), ["company_id"], [F.desc("effective_date"), F.desc("financial_id")])
    sells = latest.where(F.col("receipts").between(RECEIPTS_FLOOR, RECEIPTS_MAX)).select("company_id", F.lit(True).alias("sells"))
    best = top(projects, ["company_id"], [F.coalesce(v.stage_rank(F.col("stage")), F.lit(99)), F.col("project_id")]).join(sells, "company_id", "left_semi").select("project_id", F.lit(True).alias("sells"))
    d = projects.join(revaluable, "project_id", "left").join(best, "project_id", "left")
    begun = (F.col("production_start_date") <= as_of) & F.col("revaluable")
    produces = F.coalesce(begun, F.lit(False)) | F.coalesce(F.col("sells"), F.lit(False))
    new = F.when(produces, "production").otherwise(F.col("stage"))
    return d.select("project_id", "stage", new.alias("new_stage"), (produces & ~F.col("stage").eqNullSafe("production")).alias("promoted"))


def stage_counts(results: DataFrame) -> DataFrame:
    """Tallies of results(stage, confidence), each on its own."""
    one = lambda kind: results.where(F.col(kind).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(kind).alias("value")).agg(F.count("*").alias("n"))
    return one("stage").unionByName(one("confidence"))
