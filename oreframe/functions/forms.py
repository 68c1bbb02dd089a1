"""Reading of filed forms: patterns and the values they give, as Column expressions.

Patterns follow the wording of the forms, so they are fixed values. Text is a page
or a section; a value that isn't there is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of the quarterly cash flow form.
CASHFLOW_FOOTER = r"(?i)asx\s+listing\s+rules\s+appendix\s*5b\s*\(\d{2}/\d{2}/\d{2}\)"
CASHFLOW_POSITIVE = r"(?i)appendix\s*5b|mining\s+exploration\s+entity\s+or\s+oil\s+and\s+gas\s+exploration\s+entity|rule\s*5\.5"
CASHFLOW_DISQUALIFIERS = (r"(?i)appendix\s*4c", r"(?i)appendix\s*5a", r"(?i)appendix\s*4d", r"(?i)appendix\s*4e")
CASHFLOW_HEADER = r"(?i)appendix\s*5b\s*[–—-]\s*mining\s+exploration\s+entity"
CASHFLOW_SECTION1 = r"(?i)1\.\s*Cash\s+flows\s+from\s+operating\s+activities"
CASHFLOW_MARKERS = "(?i)appendix 5b|quarterly cash flow report|mining exploration entity"
SECTION_HEADERS = r"(?i)\b1\.\s*cash\s+flows\s+from\s+operating\s+activities|\b4\.\s*net\s+(increase|decrease).*cash|\b8\.\s*estimated\s+cash\s+available"
NUMBER = r"(\(?-?\d[\d,]*\.?\d*\)?)"
ITEMS = {"receipts": r"1\.1", "operating": r"1\.9", "exploration_evaluation": r"2\.1\s*\(?\s*d\s*\)?", "investing": r"2\.6", "financing": r"3\.10", "cash": r"4\.6"}
FUNDING = r"(?i)8\.7\s+[^\n(]*?(?:\([^)\n]*\))?\s*([\d,]+\.?\d*|N/?A|not applicable|nil|>\s*\d+)"
QUARTER_ENDED = r"(?is)quarter\s+ended.*?(\d{1,2}\s+\w+\s+\d{4})"
VALID_QUARTER_ENDS = ("03-31", "06-30", "09-30", "12-31")
#: Row labels of the form's table; the first cell of a row begins with one.
ROWS = {
    "receipts": r"^\s*1\.1\b", "operating": r"^\s*1\.9\b", "exploration_evaluation": r"^\s*2\.1\s*\(?\s*d\s*\)?", "investing": r"^\s*2\.6\b", "financing": r"^\s*3\.10\b",
    "cash_beginning": r"^\s*4\.1\b", "cash": r"^\s*4\.6\b", "facility_total": r"^\s*7\.4\b", "loan_total": r"^\s*7\.1\b", "quarters": r"^\s*8\.7\b",
}

# First words of forms on securities and the parts that hold their totals.
FORMS = {
    "appendix_2a": (r"(?i)Appendix\s*2A\s*[-–]\s*Application\s+for\s+quotation", r"(?i)Part\s*4\s*[-–]\s*Issued\s+capital\s+following\s+quotation"),
    "appendix_3h": (r"(?i)Appendix\s*3H\s*[-–]\s*Notification\s+of\s+cessation", r"(?i)Part\s*3\s*[-–]\s*Issued\s+capital\s+following\s+changes"),
    "appendix_3g": (r"(?i)Appendix\s*3G\s*[-–]\s*Notification\s+of\s+issue", r"(?i)Part\s*3\s*[-–]\s*Issued\s+capital\s+following\s+changes"),
}
FURNITURE = (r"(?i)Appendix\s*2A\s*[-–]\s*Application\s+for\s+quotation\s+of\s+securities\s*\d+\s*/\s*\d+", r"(?i)Appendix\s*3[HG]\s*[-–].*?\d+\s*/\s*\d+", r"(?i)ylno\s*esu\s*lanosrep\s*roF")
QUOTED_START, UNQUOTED_START = r"(?i)(?:4\.1\s+Quoted\s+\+?securities|3\.1\s+Quoted\s+\+?equity\s+securities)", r"(?i)(?:4\.2\s+Unquoted\s+\+?securities|3\.2\s+Unquoted\s+\+?equity\s+securities)"
QUOTED_ROW = r"^([A-Z0-9]{2,6})\s*:\s*([A-Z][A-Z0-9 .\-/()]+?)\s+([\d,]+)\s*$"
UNQUOTED_ROW = r"^([A-Z0-9]{3,8})\s*:\s*(.+?)\s+([\d,]+)\s*$"
OPTION_ROW = r"^OPTION\s+EXPIRING\s+(\d{2}-[A-Z]{3}-\d{4})\s+EX\s+\$(\d+\.\d+)$"
RIGHTS_ROW = r"^PERFORMANCE\s+RIGHTS?(?:\s+EXPIRING\s+(\d{2}-[A-Z]{3}-\d{4}))?$"
NOTE_ROW = r"^CONVERTIBLE\s+NOTES?$"
SHARE_WORDS = r"(?i)chess\s+depositary\s+interest|ordinary\s+(?:fully\s+paid\s+)?share|common\s+share|fully\s+paid\s+ordinary"
RIGHTS_WORDS = r"(?i)performance\s+right|restricted\s+stock|RSU"
TOTAL_LINE = r"([A-Z0-9]+)\s*:\s*(.+?)\s+(\d[\d,]+)\s*$"
ISSUED_COUNT = r"(?i)(?:number\s+of\s+\+?securities\s+(?:to\s+be\s+(?:issued|quoted|transferred))?)\s*\n?\s*(\d[\d,]+)"
ISSUE_PRICE = r"(?i)(?:issue\s+price|exercise\s+price|consideration)[^\d$]*?(?:AUD|A\$|\$)\s*([\d.]+)"
ISSUE_DATE = r"(?i)(?:issue\s+date|date\s+.*?issued)\s*\n?\s*(\d{1,2}/\d{1,2}/\d{4})"
FROM_CLASS = r"(?i)FROM\s+\(Existing\s+Class\)\s*\n?\s*.*?\n?\s*[A-Z0-9]+\s*:\s*(.+?)(?:\n|$)"
TO_CLASS = r"(?i)TO\s+\(Existing\s+Class\)\s*\n?\s*.*?\n?\s*[A-Z0-9]+\s*:\s*(.+?)(?:\n|$)"

# Words and phrases of presentations.
SNAPSHOT_WORDS = ("company snapshot", "capital structure", "corporate summary", "capitalization summary", "share structure", "corporate snapshot", "capital summary", "key statistics", "company overview")
FIELD_WORDS = ("shares issued", "shares on issue", "fully diluted", "market cap", "cash", "debt")
AMOUNT = r"([A-Z]{0,3}\$?\d[\d,.]*[MBK]?)"
SCALED = r"([A-Z]{0,3}\$?\d[\d,.]*\s*(?:million|billion|[MBK]))"
SNAPSHOT_FIELDS = {
    "shares_basic": r"(?i)(?:shares?\s+(?:issued|on\s+issue|outstanding))\s*[:\-–]?\s*" + AMOUNT,
    "shares_fd": r"(?i)(?:fully\s+diluted|fd\s+shares?|diluted\s+shares?)\s*[:\-–]?\s*" + AMOUNT,
    "debt": r"(?i)(?:total\s+)?(?:net\s+)?debt\s*[:\-–]?\s*(-?[A-Z]{0,3}\$?\d[\d,.]*[MBK]?)",
    "options_outstanding": r"(?i)options?\s+(?:outstanding|on\s+issue|issued)\s*[:\-–]?\s*" + AMOUNT,
    "perf_rights_outstanding": r"(?i)performance\s+rights?\s+(?:outstanding|on\s+issue|issued)?\s*[:\-–]?\s*" + AMOUNT,
}
#: In this order; the first with an amount wins.
CASH = (
    r"(?i)(?:^|\s)cash(?:\s+(?:and\s+cash\s+equivalents|position|balance|at\s+bank))?\s*[:\-–]?\s*" + AMOUNT,
    r"(?i)cash\s+(?:and\s+(?:gold|bullion)\s+)?(?:on\s+hand|balance).*?(?:was|of|to)\s+(?:~\s*)?" + SCALED,
    r"(?i)([A-Z]{0,3}\$\d[\d,.]*[MBK]?)\d?\s+cash(?:\s+(?:&|and)\s+(?:gold|bullion))?",
    r"(?i)(?:cash|bullion)\s+.*?balance\s+.*?(?:of|to)\s+(?:~\s*)?" + SCALED,
    r"(?i)cash\s+on\s+hand\s+" + AMOUNT,
)
AS_AT = (r"(?i)as\s+(?:at|of)\s+(\d{1,2}\s+\w+\s+\d{4})", r"(?i)as\s+(?:at|of)\s+(\d{1,2}/\d{1,2}/\d{4})")

# Wording of resource estimates and of studies.
RESOURCE_PROFILE = r"(?i)Mineral\s+Resource\s+Estimate|Ore\s+Reserve\s+Estimate|JORC\s*(?:Code)?\s*\(?\s*201[24]\s*\)?|Maiden\s+(?:Mineral\s+)?Resource|Resource\s+(?:Update|Upgrade)|Updated\s+Mineral\s+Resource"
RESOURCE_DISQUALIFIER = r"(?i)Appendix\s*5B|Quarterly\s+Activities?\s+Report|Notification\s+of\s+issue|Appendix\s*[23][A-H]"
RESOURCE_WORDS = ("measured", "indicated", "inferred", "proven", "proved", "probable", "total")
RESOURCE_NUMBER = r"(?i)\b\d+[,.]?\d*\s*(?:mt|kt|t|g/t|%|ppm|moz|koz)\b"
CATEGORY_LINE = r"(?i)^\s*(Measured|Indicated|Inferred|Proven|Proved|Probable|Total|Sub[\-\s]?total|Measured\s*[+&]\s*Indicated|Indicated\s*[+&]\s*Inferred|Proven\s*[+&]\s*Probable|Proved\s*[+&]\s*Probable)\b"
CATEGORIES = {
    "measured": "Measured", "indicated": "Indicated", "inferred": "Inferred", "proven": "Proven", "proved": "Proven", "probable": "Probable",
    "sub-total": "Sub-total", "sub total": "Sub-total", "subtotal": "Sub-total", "in-situ total": "In-situ Total", "in situ total": "In-situ Total", "stockpile": "Stockpiles", "stockpiles": "Stockpiles",
    "total": "Total", "grand total": "Total", "total resource": "Total", "total reserve": "Total", "total mineral resource": "Total", "total ore reserve": "Total", "global": "Total", "combined": "Total",
    "measured + indicated": "Measured+Indicated", "measured+indicated": "Measured+Indicated", "measured and indicated": "Measured+Indicated", "measured & indicated": "Measured+Indicated", "m+i": "Measured+Indicated", "m & i": "Measured+Indicated", "m&i": "Measured+Indicated",
    "indicated + inferred": "Indicated+Inferred", "indicated+inferred": "Indicated+Inferred", "indicated and inferred": "Indicated+Inferred",
    "proven + probable": "Proven+Probable", "proven+probable": "Proven+Probable", "proved + probable": "Proven+Probable", "proved+probable": "Proven+Probable", "proven and probable": "Proven+Probable", "proved and probable": "Proven+Probable", "p+p": "Proven+Probable", "2p": "Proven+Probable",
}
WHOLE_DEPOSIT = ("In-situ Total", "Stockpiles", "Total")
PURE = ("Measured", "Indicated", "Inferred", "Proven", "Probable")
RESERVES = ("Proven", "Probable", "Proven+Probable")
RESOURCES = ("Measured", "Indicated", "Inferred", "Measured+Indicated", "Indicated+Inferred")
COLUMN_WORDS = {
    "category": ("category", "classification", "class", "resource category", "reserve category", "deposit", "type", "area"),
    "tonnes": ("tonnes", "mt", "kt", "tonnage", "million tonnes", "tons"),
    "grade": ("g/t", "%", "ppm", "lb/t", "grade"),
    "contained": ("contained", "moz", "koz", "mlb", "metal", "ounces", "oz"),
}
METAL_WORDS = {
    "Au": r"(?i)\bgold\b|(?<!\.)\bAu\b", "Ag": r"(?i)\bsilver\b|(?<!\.)\bAg\b", "Cu": r"(?i)\bcopper\b|(?<!\.)\bCu\b", "Li2O": r"(?i)\blithium\b|\bLi2?O\b|\bLCE\b", "U3O8": r"(?i)\buranium\b|\bU3O8\b",
    "Ni": r"(?i)\bnickel\b|(?<!\.)\bNi\b", "Zn": r"(?i)\bzinc\b|(?<!\.)\bZn\b", "Fe": r"(?i)\biron\s*ore\b|(?<!\.)\bFe\b", "TREO": r"(?i)\brare\s*earth\b|\bREE\b|\bTREO\b", "Co": r"(?i)\bcobalt\b|(?<!\.)\bCo\b", "Graphite": r"(?i)\bgraphite\b|\bTGC\b",
}
PROJECT_NAME = (
    r"(?i)(?:at|for)\s+(?:the\s+)?([A-Z][A-Za-z0-9 \-']{2,60})\s+(?:Project|Deposit|Mine|Operation)",
    r"(?im)^([A-Z][A-Za-z0-9 \-']{3,80}?)\s+(?:Mineral\s+Resource|Ore\s+Reserve|JORC\s+Resource|Resource\s+Estimate)",
)
PROJECT_SUFFIX = r"(?i)\s+(?:Project|Deposit|Mine|Operation)\s*$"
CUTOFF = (r"(?i)cut[\-\s]?off\s+grade\s*(?:of\s*)?(\d+\.?\d*)\s*([a-zA-Z%/]+)", r"(?i)(\d+\.?\d*)\s*([a-zA-Z%/]+)\s*cut[\-\s]?off")
EFFECTIVE = (r"(?i)(?:effective|as\s+at|as\s+of)\s+(\d{1,2}\s+\w+\s+\d{4})", r"(?i)(?:effective|as\s+at|as\s+of)\s+(\d{1,2}/\d{1,2}/\d{4})")
STUDY_PROFILE = (
    r"(?i)Definitive\s+Feasibility\s+Study|\bDFS\b|Final\s+Feasibility\s+Study|Bankable\s+Feasibility\s+Study|\bBFS\b|Feasibility\s+(?:Study\s+)?(?:Update|Results|Outcomes)|Feasibility\s+Study\s+(?:Confirms|Delivers|Completed?)"
    r"|Pre[-\s]?Feasibility\s+Study|\bPFS\b|Scoping\s+Study|Preliminary\s+Economic\s+Assessment|\bPEA\b"
)
STUDY_DISQUALIFIER = r"(?i)Appendix\s*5B|Appendix\s*3[BHG]|Quarterly\s+Activities\s+Report|Half[-\s]?Year(?:ly)?\s+Report|Annual\s+Report"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What the group holds at the pattern's first place, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def count_of(s: Column) -> Column:
    return F.regexp_replace(s, ",", "").try_cast("double")


def written_date(s: Column, *formats: str) -> Column:
    """A date by the first format that fits; month names in any case."""
    return F.coalesce(*[F.try_to_date(F.initcap(F.lower(one_line(F.trim(s)))), f) for f in formats or ("d MMMM yyyy", "d MMM yyyy")])


def quarter_ended(text: Column) -> Column:
    """The date after "quarter ended", in the first 1,500 characters."""
    return written_date(found(F.substring(text, 1, 1500), QUARTER_ENDED))


def funding(s: Column) -> Column:
    """Quarters of funding: a number, or the bound of "> n"; null for words."""
    low = F.lower(F.trim(s))
    return F.when(low.isin("n/a", "na", "not applicable", "nil"), None).when(low.startswith(">"), found(low, r"^>\s*(\d+\.?\d*)").try_cast("double")).otherwise(count_of(low))


def expiry(s: Column) -> Column:
    return F.try_to_date(F.initcap(s), "dd-MMM-yyyy")


def security_class(description: Column) -> Column:
    return F.when(description.rlike(SHARE_WORDS), "ordinary").when(description.rlike("(?i)option|warrant"), "option").when(description.rlike(RIGHTS_WORDS), "performance_right").otherwise("other")


def cdi_shares(description: Column, count: Column) -> Column:
    """Shares that a row of depositary interests stands for; other rows as they are."""
    a, b = found(description, r"(\d+)\s*:\s*(\d+)", 1).cast("double"), found(description, r"(\d+)\s*:\s*(\d+)", 2).cast("double")
    return F.when(_is_cdi(description) & a.isNotNull() & (a != 0), count * b / a).otherwise(count)


def _is_cdi(description: Column) -> Column:
    return description.rlike(r"(?i)chess\s+depositary\s+interest|\bCDI\b")


def cdi_warning(description: Column) -> Column:
    a, b = found(description, r"(\d+)\s*:\s*(\d+)", 1), found(description, r"(\d+)\s*:\s*(\d+)", 2)
    return F.when(_is_cdi(description), F.when(a.isNull(), "cdi_ratio_unknown_assumed_1:1").when(a != b, F.concat(F.lit("cdi_ratio_"), a, F.lit(":"), b)))


def page_score(text: Column) -> Column:
    low = F.lower(text)
    points = [(w, 10) for w in SNAPSHOT_WORDS] + [(w, 3) for w in FIELD_WORDS]
    return sum((F.when(low.contains(w), n).otherwise(0) for w, n in points), F.lit(0))


def category(label: Column) -> Column:
    """The category that a row label names; longer names first."""
    low, out = F.lower(label), None
    for key, name in sorted(CATEGORIES.items(), key=lambda x: -len(x[0])):
        out = F.when(low.contains(key), name) if out is None else out.when(low.contains(key), name)
    return out


def column_kind(header: Column) -> Column:
    h = F.lower(one_line(F.trim(header)))
    has = lambda kind: F.coalesce(sum((F.when(h.contains(w), 1).otherwise(0) for w in COLUMN_WORDS[kind]), F.lit(0)) > 0, F.lit(False))
    cutoff = h.contains("cut-off") | h.contains("cutoff") | h.contains("cut off")
    return F.when(has("category"), "category").when(has("tonnes"), "tonnes").when(cutoff, None).when(has("grade"), "grade").when(has("contained"), "contained")


def grade_unit(headers: Column) -> Column:
    return _first_unit(headers, lambda h: F.when(h.contains("g/t"), "g/t").when(h.contains("%"), "%").when(h.contains("ppm"), "ppm").when(h.contains("lb/t"), "lb/t"), "g/t")


def contained_unit(headers: Column) -> Column:
    return _first_unit(headers, lambda h: F.when(h.contains("moz"), "Moz").when(h.contains("koz"), "Koz").when(h.contains("mlb"), "Mlb").when(h.contains("kt"), "Kt").when(h.contains("oz"), "Oz"), None)


def tonnes_unit(headers: Column) -> Column:
    return _first_unit(headers, lambda h: F.when(h.contains("kt") & ~h.contains("million"), "kt").when(h.contains("mt") | h.contains("million"), "Mt"), "Mt")


def _first_unit(headers: Column, unit, default: str | None) -> Column:
    known = F.filter(F.transform(headers, lambda h: unit(F.lower(one_line(F.trim(h))))), lambda u: u.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit(default))


def read_cell(cells: Column, at: Column) -> Column:
    """The number at a place, or in the cell before, or in the one after."""
    number = lambda i: F.when(i >= 0, cell_number(F.get(cells, i)))
    return F.coalesce(number(at), number(at - 1), number(at + 1))


def cell_number(cell: Column) -> Column:
    t = F.regexp_replace(F.trim(cell), r"(?i)\s*(Mt|kt|t|g/t|%|ppm|lb/t|Moz|koz|Mlb|oz)\s*$", "")
    n = F.regexp_replace(F.trim(t), ",", "")
    return F.when(n.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), n.cast("double"))


def metals(text: Column) -> Column:
    """Metals that the text names, in a fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), m) for m, p in METAL_WORDS.items()]))


def polymetallic_warning(names: Column) -> Column:
    return F.when(F.size(names) > 1, F.concat(F.lit("polymetallic_deposit_detected:"), F.array_join(names, "+"), F.lit("_using_"), F.get(names, F.lit(0))))


def expected_contained(tonnes_mt: Column, grade: Column, grade_unit: Column, unit: Column) -> Column:
    """Contained metal by tonnes and grade, in unit; null where the units don't go together."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    ounces = tonnes_mt * 1e6 * grade / 31.1035
    tonnes = tonnes_mt * 1e6 * grade / 100
    per_oz = F.when(u == "moz", 1e6).when(u == "koz", 1e3).when(u == "oz", 1.0)
    per_t = F.when(u == "mt", 1e6).when(u == "kt", 1e3).when(u == "t", 1.0).when(u == "mlb", 1e6 / 2204.62262).when(u == "klb", 1e3 / 2204.62262)
    return F.when(grade_unit == "g/t", ounces / per_oz).when(grade_unit == "%", tonnes / per_t)
