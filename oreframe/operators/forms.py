"""Operators on page text: pages(document_id, page_no, text), and tables of lines and cells made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import forms as f
from ..functions import text as t

KEY = "document_id"


def classify_documents(filings: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id and doc_type: by the headline, else by the first page, else other."""
    first = pages.where("page_no = 1").select(KEY, t.first_page_type(F.col("text")).alias("by_page"))
    return filings.join(first, KEY, "left").select(KEY, F.coalesce(t.headline_type(F.col("header")), "by_page", F.lit("other")).alias("doc_type"))


def embedded_form(pages: DataFrame) -> DataFrame:
    """The standard form that a document holds: of the first page with one; a cash flow form needs a numbered section on the same page."""
    low = F.lower("text")
    kind = (
        F.when(low.rlike("appendix 5b|quarterly cash flow report|mining exploration entity") & low.rlike(f.SECTION_HEADERS), "appendix_5b")
        .when(low.rlike("appendix 3g|appendix 2a|notification of issue, conversion or payment|application for quotation of securities"), "issue_of_securities")
    )
    return pages.withColumn("kind", kind).where("kind is not null").groupBy(KEY).agg(F.min_by("kind", "page_no").alias("form"))


def cashflow_gate(pages: DataFrame) -> DataFrame:
    """Whether a document holds a quarterly cash flow form: "ok" or why not."""
    text = f.one_line(F.col("text"))
    first, positive = F.col("page_no") == 1, text.rlike(f.CASHFLOW_POSITIVE)
    odd = F.coalesce(*[f.found(text, f"({p})") for p in f.CASHFLOW_DISQUALIFIERS])
    d = pages.groupBy(KEY).agg(
        F.bool_or(text.rlike(f.CASHFLOW_FOOTER)).alias("footer"), F.bool_or(first & positive).alias("on_first"), F.max(F.when(first, F.lower(odd))).alias("odd"), F.bool_or(~first & positive).alias("later"),
    )
    reason = F.when(F.col("footer"), "ok").when(F.col("on_first") & F.col("odd").isNotNull(), F.concat(F.lit("disqualifier:"), "odd")).when(F.col("on_first") | F.col("later"), "ok").otherwise("no_5b_marker_on_any_page")
    return d.select(KEY, reason.alias("reason"))


def quarter_end_gate(date: Column) -> Column:
    return F.when(date.isNull(), "missing_effective_date").when(F.date_format(date, "MM-dd").isin(*f.VALID_QUARTER_ENDS), "ok").otherwise(F.concat(F.lit("not_quarter_end:"), date.cast("string")))


def cashflow_section(pages: DataFrame) -> DataFrame:
    """The cash flow form of each document: its text from the first page by footer, else by form header, else by marker."""
    text = f.one_line(F.col("text"))
    marker = F.col("text").rlike(f.CASHFLOW_MARKERS)
    at = lambda c: F.min(F.when(c, F.col("page_no")))
    start = pages.groupBy(KEY).agg(F.coalesce(at(text.rlike(f.CASHFLOW_FOOTER)), at(text.rlike(f.CASHFLOW_HEADER) | (text.rlike(f.CASHFLOW_SECTION1) & marker)), at(marker)).alias("start_page")).where("start_page is not null")
    return joined_pages(pages.join(start, KEY).where("page_no >= start_page"), "start_page")


def joined_pages(pages: DataFrame, *also: str) -> DataFrame:
    """One row per document with its pages' text in order."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    return pages.groupBy(KEY, *also).agg(F.array_join(in_order, "\n").alias("section"))


def cashflow_items(section: Column) -> dict[str, Column]:
    """Figures of the form's numbered items, as written (thousands, inflows positive)."""
    out = {name: t.parse_amount(f.found(section, rf"(?i){item}\s+.*?{f.NUMBER}")) for name, item in f.ITEMS.items()}
    drawn = [t.parse_amount(f.found(section, rf"(?i){item}\s+.*?{f.NUMBER}(?:\s+{f.NUMBER})?", 2)) for item in (r"7\.4", r"7\.1")]
    out["debt"] = F.coalesce(*[F.when(x > 0, x) for x in drawn])
    out["quarters_of_funding"] = f.funding(f.found(section, f.FUNDING))
    out["effective_date"] = f.quarter_ended(section)
    return out


def cashflow_rows(rows: DataFrame) -> DataFrame:
    """The same figures from table rows (document_id, row_no, cells): the one before last of a row's numbers, or its only one."""
    label = F.get("cells", F.lit(0))
    item = None
    for name, pattern in f.ROWS.items():
        item = F.when(label.rlike(pattern), name) if item is None else item.when(label.rlike(pattern), name)
    rest = F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))
    numbers = F.array_compact(F.transform(rest, t.parse_amount))
    last = F.try_element_at(F.filter(rest, lambda c: F.trim(c) != ""), F.lit(-1))
    r = rows.withColumn("item", item).where("item is not null").withColumns({"numbers": numbers, "last": last})
    value = F.when(F.size("numbers") >= 2, F.try_element_at("numbers", F.lit(-2))).otherwise(F.try_element_at("numbers", F.lit(-1)))
    first = lambda name, c: F.min_by(c, F.when(F.col("item") == name, F.col("row_no")))
    plain = ("receipts", "operating", "exploration_evaluation", "investing", "financing", "cash_beginning", "cash")
    return r.groupBy(KEY).agg(
        *[first(n, value).alias(n) for n in plain], F.coalesce(first("facility_total", drawn_debt(F.col("numbers"))), first("loan_total", drawn_debt(F.col("numbers")))).alias("debt"),
        first("quarters", f.funding(F.col("last"))).alias("quarters_of_funding"),
    )


def drawn_debt(values: Column) -> Column:
    """The drawn part of a facility's row (total, drawn); a lone number says nothing."""
    return F.when(F.size(values) >= 2, F.try_element_at(values, F.lit(-1)))


CRITICAL = ("cash", "operating", "investing")


def fill_missing(primary: DataFrame, fallback: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """primary, with nulls taken from fallback where a critical figure is missing."""
    short = F.greatest(*[F.col(f"a.{c}").isNull().cast("int") for c in CRITICAL]) == 1
    return primary.alias("a").join(fallback.alias("b"), KEY, "left").select(KEY, *[F.when(short, F.coalesce(f"a.{c}", f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in fields])


def finalize_cashflow(items: DataFrame) -> DataFrame:
    """Dollars, and burn with outflow positive. The text of a form doesn't give cash_beginning; only its table rows do."""
    items = items if "cash_beginning" in items.columns else items.withColumn("cash_beginning", F.lit(None).cast("double"))
    dollars = {"cash": "cash", "cash_beginning": "cash_beginning", "debt": "debt", "receipts_from_customers": "receipts", "quarterly_financing": "financing"}
    burns = {"quarterly_opex_burn": "operating", "quarterly_invest_burn": "investing", "exploration_evaluation": "exploration_evaluation"}
    return items.select(
        KEY, "effective_date", "quarters_of_funding", *[(F.col(c) * 1000).alias(n) for n, c in dollars.items()], *[(F.col(c) * -1000).alias(n) for n, c in burns.items()],
    )


def form_profile(pages: DataFrame) -> DataFrame:
    """Which form on securities a document is: its title on the first two pages and the part with the totals on any."""
    text, early = F.col("text"), F.col("page_no") <= 2
    seen = pages.groupBy(KEY).agg(*[x for name, (title, part) in f.FORMS.items() for x in (F.bool_or(early & text.rlike(title)).alias(f"{name}_title"), F.bool_or(text.rlike(part)).alias(f"{name}_part"))])
    title = F.coalesce(*[F.when(F.col(f"{n}_title"), n) for n in f.FORMS])
    has_part = F.coalesce(*[F.when(title == n, F.col(f"{n}_part")) for n in f.FORMS])
    return seen.select(KEY, F.when(has_part, title).alias("form"))


def strip_furniture(text: Column) -> Column:
    for p in f.FURNITURE:
        text = F.regexp_replace(text, p, "")
    return text


def capital_section(pages: DataFrame) -> DataFrame:
    """The part of a form on securities that holds the totals, without footers."""
    part = "(?i)" + "|".join(p.removeprefix("(?i)") for p in dict.fromkeys(part for _, part in f.FORMS.values()))
    start = pages.where(F.col("text").rlike(part)).groupBy(KEY).agg(F.min("page_no").alias("start_page"))
    out = joined_pages(pages.join(start, KEY).where("page_no >= start_page"))
    return out.select(KEY, strip_furniture(F.col("section")).alias("section"))


def security_rows(sections: DataFrame) -> DataFrame:
    """A row for each security of sections(document_id, section), in their order.

    Quoted rows are shares unless they name options, rights or notes; unquoted
    rows that fit no pattern are "other" with a warning.
    """
    halves = F.split("section", f.UNQUOTED_START, 2)
    quoted = F.get(F.split(F.get(halves, F.lit(0)), f.QUOTED_START, 2), F.lit(1))
    d = sections.select(KEY, F.explode(F.array(F.struct(F.lit(True).alias("quoted"), quoted.alias("part")), F.struct(F.lit(False).alias("quoted"), F.get(halves, F.lit(1)).alias("part")))).alias("x")).select(KEY, "x.*")
    line = d.select(KEY, "quoted", F.posexplode(F.split("part", "\n")).alias("line_no", "line"))
    hit = F.when(F.col("quoted"), F.col("line").rlike(f.QUOTED_ROW)).otherwise(F.col("line").rlike(f.UNQUOTED_ROW))
    group = lambda k: F.when(F.col("quoted"), F.regexp_extract("line", f.QUOTED_ROW, k)).otherwise(F.regexp_extract("line", f.UNQUOTED_ROW, k))
    r = line.where(hit).select(KEY, "quoted", "line_no", group(1).alias("code"), F.trim(group(2)).alias("description"), F.regexp_replace(group(3), ",", "").cast("long").alias("total_on_issue"))
    text = F.col("description")
    kind = F.when(
        F.col("quoted"), F.when(text.rlike(r"(?i)\boption\b|\bwarrant\b"), "option").when(text.rlike(r"(?i)\bperformance\s+right"), "performance_right").when(text.rlike(r"(?i)\bconvertible\s+note"), "convertible_note").otherwise("share")
    ).otherwise(F.when(text.rlike(f.OPTION_ROW), "option").when(text.rlike(f.NOTE_ROW), "convertible_note").when(text.rlike(f.RIGHTS_ROW), "performance_right").otherwise("other"))
    r = r.withColumn("kind", kind)
    until = F.when(F.col("kind") == "option", f.expiry(f.found(text, r"EXPIRING\s+(\d{2}-[A-Z]{3}-\d{4})"))).when(F.col("kind") == "performance_right", f.expiry(f.found(text, f.RIGHTS_ROW)))
    return r.withColumns({
        "expiry_date": until, "strike": F.when(F.col("kind") == "option", f.found(text, r"EX\s+\$([\d.]+)").try_cast("decimal(18,6)")),
        "warning": F.when(F.col("kind") == "other", "unquoted_row_unparsed").when((F.col("kind") == "option") & ~F.col("quoted") & until.isNull(), "option_unparsed_expiry"),
    })


def capital_totals(rows: DataFrame) -> DataFrame:
    """Basic and fully diluted shares of each document; status tells those without quoted shares."""
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("total_on_issue"))), F.lit(0))
    kind = F.col("kind")
    d = rows.groupBy(KEY).agg(
        of(kind == "share").alias("shares_basic"), of(kind != "share").alias("others"), of(kind == "option").alias("options_outstanding"), of(kind == "convertible_note").alias("convertible_notes"), of(kind == "performance_right").alias("performance_rights"),
    )
    return d.select(KEY, "shares_basic", (F.col("shares_basic") + F.col("others")).alias("shares_fd"), "options_outstanding", "convertible_notes", "performance_rights", F.when(F.col("shares_basic") == 0, "no_quoted_classes_parsed").otherwise("ok").alias("status"))


def notes_flag(needs_review: Column, reason: Column, notes: Column) -> tuple[Column, Column]:
    """Review flag and reason, raised where convertible notes make the diluted count unreliable."""
    has = F.coalesce(notes, F.lit(0)) > 0
    return needs_review | has, F.when(has, F.concat_ws("; ", reason, F.lit("cn_present_fd_unreliable"))).otherwise(reason)


def security_totals(pages: DataFrame) -> DataFrame:
    """Totals on issue by class, from lines of the form's fourth part (the whole text without one); counts under 100 aren't totals."""
    whole = joined_pages(pages)
    part = F.coalesce(f.found(F.col("section"), r"(?is)(Part\s*4\b.*)"), F.col("section"))
    line = whole.select(KEY, F.explode(F.split(part, "\n")).alias("line")).where(F.col("line").rlike(f.TOTAL_LINE))
    r = line.select(KEY, F.trim(F.regexp_extract("line", f.TOTAL_LINE, 2)).alias("description"), f.count_of(F.regexp_extract("line", f.TOTAL_LINE, 3)).alias("n")).where("n >= 100")
    r = r.withColumn("kind", f.security_class(F.col("description"))).where("kind <> 'other'")
    shares = f.cdi_shares(F.col("description"), F.col("n"))
    of = lambda k, c: F.sum(F.when(F.col("kind") == k, c))
    return r.groupBy(KEY).agg(of("ordinary", shares).alias("total_shares"), of("option", F.col("n")).alias("total_options"), of("performance_right", F.col("n")).alias("total_rights"))


def issue_details(section: Column) -> dict[str, Column]:
    return {
        "issued_count": f.count_of(f.found(section, f.ISSUED_COUNT)), "issue_price": f.found(section, f.ISSUE_PRICE).try_cast("double"), "issue_date": F.try_to_date(f.found(section, f.ISSUE_DATE), "d/M/yyyy"),
        "converted_from": F.when(f.found(section, f.FROM_CLASS).isNotNull(), f.security_class(f.found(section, f.FROM_CLASS))), "converted_to": F.when(f.found(section, f.TO_CLASS).isNotNull(), f.security_class(f.found(section, f.TO_CLASS))),
    }


def top_pages(pages: DataFrame, k: int = 3, least: int = 3) -> DataFrame:
    """The k best pages of each document by keywords, of those with a score of least or more."""
    scored = pages.withColumn("score", f.page_score(F.col("text"))).where(F.col("score") >= least)
    return scored.withColumn("place", F.row_number().over(W.partitionBy(KEY).orderBy(F.desc("score"), "page_no"))).where(F.col("place") <= k)


def snapshot_fields(pages: DataFrame) -> DataFrame:
    """Capital figures of a presentation's best pages; documents with neither shares nor cash are left out."""
    best = top_pages(pages)
    whole = best.groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("s"))
    s = F.col("s")
    cash = [t.scaled_amount(f.found(s, p)) for p in f.CASH]
    d = whole.select(
        KEY, *[t.scaled_amount(f.found(s, p)).alias(n) for n, p in f.SNAPSHOT_FIELDS.items()], F.coalesce(*[F.when(c != 0, c) for c in cash], cash[0]).alias("cash"),
        F.coalesce(f.written_date(f.found(s, f.AS_AT[0])), F.try_to_date(f.found(s, f.AS_AT[1]), "d/M/yyyy")).alias("effective_date"),
    )
    any_ = [F.coalesce(F.col(c) != 0, F.lit(False)) for c in ("shares_basic", "shares_fd", "cash")]
    return d.where(any_[0] | any_[1] | any_[2])


def resource_profile(pages: DataFrame) -> DataFrame:
    """Whether a document holds a resource estimate: its title on the first three pages, no other form on the first, and a page of categories with quantities."""
    text, low = F.col("text"), F.lower("text")
    words = sum((low.contains(w).cast("int") for w in f.RESOURCE_WORDS), F.lit(0))
    d = pages.groupBy(KEY).agg(
        F.bool_or((F.col("page_no") <= 3) & text.rlike(f.RESOURCE_PROFILE)).alias("named"), F.bool_or((F.col("page_no") == 1) & text.rlike(f.RESOURCE_DISQUALIFIER)).alias("other_form"),
        F.bool_or((F.col("page_no") <= 20) & (words >= 2) & text.rlike(f.RESOURCE_NUMBER)).alias("has_table"),
    )
    return d.select(KEY, (F.col("named") & ~F.col("other_form") & F.col("has_table")).alias("is_estimate"))


def study_profile(pages: DataFrame) -> DataFrame:
    """Whether a document announces a study: on the first three pages; another form's title on the first counts unless the study is named there too."""
    text, first = F.col("text"), F.col("page_no") == 1
    named = text.rlike(f.STUDY_PROFILE)
    d = pages.groupBy(KEY).agg(F.bool_or((F.col("page_no") <= 3) & named).alias("named"), F.bool_or(first & text.rlike(f.STUDY_DISQUALIFIER)).alias("other_form"), F.bool_or(first & named).alias("on_first"))
    return d.select(KEY, (F.col("named") & (~F.col("other_form") | F.col("on_first"))).alias("is_study"))


def resource_rows(pages: DataFrame) -> DataFrame:
    """Table rows found in text: lines that begin with a category and hold numbers, on pages with two or more.

    cells are the first n numbers, n being the page's most common count (the
    smaller of equally common ones); headers come from the first of the three lines
    above the table that splits into columns.
    """
    line = pages.where("page_no <= 25").select(KEY, "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    label = F.trim(F.regexp_extract("line", f.CATEGORY_LINE, 1))
    rest = F.regexp_replace("line", f.CATEGORY_LINE, "")
    line = line.withColumns({"label": F.nullif(label, F.lit("")), "numbers": F.regexp_extract_all(rest, F.lit(r"[\d,]+\.?\d*"), F.lit(0)), "parts": F.split(F.trim("line"), r"\s{2,}")})
    page = W.partitionBy(KEY, "page_no")
    begins = F.min(F.when(F.col("label").isNotNull(), F.col("line_no"))).over(page)
    is_header = (F.col("line_no") < F.col("begins")) & (F.col("line_no") >= F.col("begins") - 3) & (F.size("parts") >= 2)
    line = line.withColumn("begins", begins).withColumn("headers", F.min_by("parts", F.when(is_header, F.col("line_no"))).over(page))
    row = line.where("label is not null and size(numbers) > 0").withColumns({"n_rows": F.count("*").over(page), "n": F.size("numbers")})
    sizes = row.groupBy(KEY, "page_no", "n").agg(F.count("*").alias("times")).groupBy(KEY, "page_no").agg(F.min_by("n", F.struct((-F.col("times")).alias("t"), F.col("n").alias("k"))).alias("columns"))
    return row.where("n_rows >= 2").join(sizes, [KEY, "page_no"]).select(KEY, "page_no", "line_no", "label", F.slice("numbers", F.lit(1), F.col("columns")).alias("cells"), "columns", "headers")


def carry_section(rows: DataFrame) -> DataFrame:
    """rows(document_id, row_no, label, empty) with the section that each is in: a header row (empty, no category) fills down; whole-deposit rows have none."""
    category = f.category(F.col("label"))
    title = F.trim(F.regexp_replace("label", r"\s*\(.*$", ""))
    header = F.when(F.col("empty") & ~F.lower("label").rlike("|".join(f.RESOURCE_WORDS)), F.nullif(f.one_line(title), F.lit("")))
    d = rows.withColumns({"category": category, "header": header})
    d = d.withColumn("carried", F.last("header", ignorenulls=True).over(W.partitionBy(KEY).orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)))
    return d.where("header is null and category is not null").select(KEY, "row_no", "category", F.when(~F.col("category").isin(*f.WHOLE_DEPOSIT), F.col("carried")).alias("section"))


def split_reserves(rows: DataFrame) -> DataFrame:
    """rows(document_id, table_no, category, ...) without tables of reserves alone, and without the reserve rows of mixed ones."""
    table = W.partitionBy(KEY, "table_no")
    has = lambda names: F.bool_or(F.coalesce(F.col("category").isin(*names), F.lit(False))).over(table)
    d = rows.withColumns({"reserve": has(f.RESERVES), "resource": has(f.RESOURCES)})
    kept = (~F.col("reserve") | F.col("resource")) & ~(F.col("reserve") & F.col("category").isin(*f.RESERVES))
    return d.where(kept).withColumn("warning", F.when(F.col("reserve"), "mixed_resource_reserve_table")).drop("reserve", "resource")


def project_name(text: Column) -> Column:
    """A project's name as the text has it; fragments of prose are refused."""
    names = [F.trim(F.regexp_replace(F.trim(f.found(text, p)), f.PROJECT_SUFFIX, "")) for p in f.PROJECT_NAME]
    return F.coalesce(*[F.when(~t.is_prose_name(n), n) for n in names])


def cutoff(text: Column) -> tuple[Column, Column]:
    number = [f.found(text, p, 1) for p in f.CUTOFF]
    unit = [f.found(text, p, 2) for p in f.CUTOFF]
    return F.coalesce(*number).cast("double"), F.when(number[0].isNotNull(), unit[0]).otherwise(unit[1])


def effective_date(text: Column, announced: Column) -> Column:
    return F.coalesce(f.written_date(f.found(text, f.EFFECTIVE[0])), F.try_to_date(f.found(text, f.EFFECTIVE[1]), "d/M/yyyy"), announced)
