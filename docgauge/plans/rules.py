"""The check catalogue: each rule is a Column over one wide document row that ends in PASS, VERIFY or FAIL.

A document row has ``doc_id``, ``raw_text``, ``loan_type``, ``assignment_type`` and the structs ``subject``,
``contract``, ``neighborhood``, ``site``, ``improvements``, ``sales``, ``letter`` and ``agreement``. Any of them, and any
field in them, may be absent: a missing field reads as null. All rules of a document are one projection, exploded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docgauge.functions import commentary
from docgauge.functions.dates import parse_date, parse_date_or_text
from docgauge.functions.numeric import outcome
from docgauge.functions.similarity import sequence_ratio
from docgauge.functions.text import folded, let, same_street, squeezed, street_tokens, upper_key

PASS, VERIFY, FAIL = "PASS", "VERIFY", "FAIL"


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outer bars, those of one group that spans it too."""
    parts, depth = [""], 0
    for t in re.findall(r"(?s)\\.|\[(?:\\.|[^\]\\])*\]|.", pattern):
        depth += (t == "(") - (t == ")")
        if depth < 0:
            return []
        if t == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += t
    group = re.fullmatch(r"(?s)(\\b)?\((?:\?:)?([^?].*)\)(\\b)?", pattern)
    inner = alternatives(group[2]) if group and len(parts) == 1 else []
    return [f"{group[1] or ''}{p}{group[3] or ''}" for p in inner] or parts


def lead(part: str) -> str:
    """The literal that every match of a part without outer bars begins with, in lower case."""
    m = re.match(r"(?:\\b)?([A-Za-z0-9 ;/&#-]*)(.?)", part, re.DOTALL)
    return (m[1][:-1] if m[2] and m[2] in "?*{" else m[1]).lower()


class Doc:
    """Null-safe access to the fields of a document row; ``low`` is its folded text, where that is at hand."""

    def __init__(self, schema: StructType, as_of_year: int, low: Column | None = None):
        self.schema, self.as_of_year = schema, as_of_year
        self.low = folded(self.text) if low is None else low

    def __call__(self, path: str, cast: str = "string") -> Column:
        node, parts = self.schema, path.split(".")
        for p in parts:
            if not isinstance(node, StructType) or p not in node.fieldNames():
                return F.lit(None).cast(cast)
            node = node[p].dataType
        return F.col(path).cast(cast)

    @property
    def text(self) -> Column:
        return F.coalesce(self("raw_text"), F.lit(""))

    def has(self, pattern: str, dot_all: bool = False) -> Column:
        """Whether the text holds the pattern, ignoring case.

        A part between bars is looked for only behind the literal that it begins with, which the folded text holds or
        not; one that is such a literal throughout needs no pattern.
        """
        own = re.match(r"\(\?[a-z-]+\)", pattern)
        flags = ("(?is)" if dot_all else "(?i)") + (own[0] if own else "")
        pattern = pattern[own.end() :] if own else pattern
        if "-i" in flags:
            return self.text.rlike(flags + pattern)
        tests, rest = [], []
        for part in alternatives(pattern):
            known = lead(part)
            if known == part.lower():
                tests.append(self.low.contains(known))
            elif len(known) >= 3:
                tests.append(self.low.contains(known) & self.text.rlike(flags + part))
            else:
                rest.append(part)
        if rest:
            tests.append(self.text.rlike(flags + "|".join(rest)))
        return reduce(or_, tests)

    def blank(self, path: str) -> Column:
        return F.trim(F.coalesce(self(path), F.lit(""))) == ""

    def any_null(self, *paths: str) -> Column:
        out = F.lit(False)
        for p in paths:
            out = out | self(p).isNull() | (F.trim(self(p)) == "")
        return out

    def short(self, path: str, n: int) -> Column:
        return F.length(F.trim(F.coalesce(self(path), F.lit("")))) < n

    @property
    def comps(self) -> Column | None:
        node = self.schema
        for p in ("sales", "comparables"):
            if not isinstance(node, StructType) or p not in node.fieldNames():
                return None
            node = node[p].dataType
        return F.coalesce(F.col("sales.comparables"), F.expr("array()").cast(node))

    def comp_fields(self) -> list[str]:
        return self.schema["sales"].dataType["comparables"].dataType.elementType.fieldNames() if self.comps is not None else []

    def comps_lack(self, field: str) -> Column:
        """No comparables, or one without the field."""
        if self.comps is None or field not in self.comp_fields():
            return F.lit(True)
        return (F.size(self.comps) == 0) | F.exists(self.comps, lambda c: F.coalesce(F.trim(c[field].cast("string")), F.lit("")) == "")

    def comps_fail(self, field: str, pattern: str) -> Column:
        """A comparable whose field doesn't fit the pattern."""
        if self.comps is None or field not in self.comp_fields():
            return F.lit(False)
        return F.exists(self.comps, lambda c: ~F.coalesce(c[field].cast("string"), F.lit("")).rlike(pattern))


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    order: int
    loans: str
    status: Callable[[Doc], Column]


REGISTRY: dict[str, Rule] = {}


def register(rule: Rule) -> None:
    """A rule registered again under its id replaces the old one."""
    REGISTRY[rule.id] = rule


def rule(id_: str, name: str, severity: str, order: int, loans: str = "ALL"):
    def wrap(f: Callable[[Doc], Column]) -> Callable[[Doc], Column]:
        register(Rule(id_, name, severity, order, loans, f))
        return f

    return wrap


# fixed values: rules on the text alone. id, name, severity, order, loans, status where every pattern is found, status
# where one is not, patterns. "." in a pattern crosses lines where it is marked (?s).
TEXT_RULES = [
    ("I-4", "Interior Description", "STANDARD", 430, "ALL", PASS, VERIFY, [r"\b(Floors?|Walls?|Trim/Finish|Bath\s+Floor|Bath\s+Wainscot|Interior)\b"]),
    ("I-6", "Appliances", "STANDARD", 450, "FHA", PASS, VERIFY, [r"\b(appliance|dishwasher|range|oven|microwave|disposal|refrigerator)\b"]),
    ("I-8", "Additional Features", "ADVISORY", 470, "ALL", PASS, VERIFY, [r"\bAdditional\s+Features\b|\bStandard insulation\b|\benergy efficient\b|\bnone\b"]),
    ("I-12", "Additions to Subject", "STANDARD", 510, "ALL", VERIFY, VERIFY, [r"\b(addition|converted|unpermitted|permit)\b"]),
    ("I-13", "Security Bars", "STANDARD", 520, "ALL", VERIFY, PASS, [r"security bars?|window bars?|release latch"]),
    ("SCA-7", "Sale or Financing Concessions", "STANDARD", 660, "ALL", VERIFY, VERIFY, [r"ArmLth|Conv;?\s*\d+|Cash;?\s*0|RH;?\s*\d+|Concessions"]),
    ("SCA-10", "Leasehold/Fee Simple", "STANDARD", 690, "ALL", PASS, VERIFY, [r"Fee\s+Simple"]),
    ("SCA-12", "View", "ADVISORY", 710, "ALL", VERIFY, VERIFY, [r"\bN;Res;|View"]),
    ("SCA-13", "Design (Style)", "ADVISORY", 720, "ALL", PASS, VERIFY, [r"DT1;Traditional|Design\s*\(Style\)"]),
    ("SCA-18", "Basement & Finished Rooms Below Grade", "STANDARD", 770, "ALL", VERIFY, VERIFY, [r"Basement|Rooms\s+Below\s+Grade|0sf"]),
    ("SCA-19", "Functional Utility", "ADVISORY", 780, "ALL", PASS, VERIFY, [r"Functional\s+Utility|Average"]),
    ("SCA-20", "Heating/Cooling", "STANDARD", 790, "ALL", PASS, VERIFY, [r"Heating/Cooling|FWA/CAC|Central\s+Air"]),
    ("SCA-22", "Porch/Patio/Deck", "ADVISORY", 810, "ALL", PASS, VERIFY, [r"Porch/Patio/Deck|CFP|CBP|Patio|Porch|Deck"]),
    ("SCA-25", "New Construction", "ADVISORY", 840, "ALL", VERIFY, PASS, [r"new construction|proposed construction|under construction"]),
    ("SCA-27", "Comparable Photos", "STANDARD", 860, "FHA", VERIFY, VERIFY, [r"comp(?:arable)?\s+photo|MLS\s+photo|drive-?by|Comparable\s+Sale\s+#"]),
    ("R-1", "Value Reconciliation", "STANDARD", 900, "ALL", PASS, VERIFY, [r"reconciliation|indicated value by sales comparison|sales comparison approach", r"weight|weighted|most reliable|best indicator|given.*consideration|supportive and reasonable conclusion|opinion of market value"]),
    ("R-2", "Final Opinion of Value", "STANDARD", 910, "ALL", PASS, VERIFY, [r"(?:final opinion of value|appraised value|opinion of value|Indicated Value by Sales Comparison Approach|APPRAISED VALUE OF SUBJECT PROPERTY)\s*[:$]?\s*\$?\d[\d,]+"]),
    ("CA-2", "Cost Approach Completion", "STANDARD", 960, "USDA", PASS, VERIFY, [r"cost approach", r"opinion of site value|site value", r"cost new|replacement cost new", r"depreciation", r"indicated value"]),
    ("IA-1", "Subject Rent Matching", "STANDARD", 970, "ALL", VERIFY, VERIFY, [r"gross monthly rent|subject rent schedule|form\s*1007"]),
    ("IA-2", "Operating Income Statement (Form 216)", "STANDARD", 980, "ALL", PASS, VERIFY, [r"form\s*216|operating income statement"]),
    ("ADD-3", "Dated Sales Commentary", "ADVISORY", 1020, "ALL", VERIFY, VERIFY, [r"dated sale|over\s+12\s+months|distant comparable|outside.*neighborhood"]),
    ("ADD-4", "Market Conditions Addendum (1004MC)", "STANDARD", 1030, "FHA,USDA", PASS, VERIFY, [r"1004MC|Market Conditions Addendum"]),
    ("ADD-5", "1004MC Inventory Analysis", "STANDARD", 1040, "FHA,USDA", VERIFY, VERIFY, [r"Inventory\s+Analysis|Absorption\s+Rate|Months\s+of\s+Housing\s+Supply|Total\s+#\s+of\s+Comparable"]),
    ("ADD-6", "1004MC Comparables Matching", "STANDARD", 1050, "FHA,USDA", VERIFY, VERIFY, [r"Total\s+#\s+of\s+Comparable\s+Sales", r"There\s+are\s+\d+\s+comparable"]),
    ("ADD-7", "1004MC Overall Trend", "STANDARD", 1060, "ALL", VERIFY, VERIFY, [r"(?s)\bIncreasing\b.*\bStable\b.*\bDeclining\b"]),
    ("ADD-9", "USPAP 2014 Addendum", "STANDARD", 1080, "ALL", VERIFY, VERIFY, [r"USPAP|exposure time|appraisal report|restricted appraisal report"]),
    ("DOC-1", "Appraiser License", "STANDARD", 1100, "ALL", VERIFY, VERIFY, [r"license|certification|certified residential|state certified"]),
    ("DOC-2", "E&O Insurance", "ADVISORY", 1110, "ALL", VERIFY, VERIFY, [r"errors?\s*&\s*omissions|E&O|insurance"]),
    ("DOC-3", "UAD Data Set", "ADVISORY", 1120, "ALL", PASS, VERIFY, [r"\bUAD\b|Uniform Appraisal Dataset"]),
    ("DOC-4", "Trainee Signatures", "STANDARD", 1130, "ALL", VERIFY, PASS, [r"trainee|supervisory appraiser"]),
    ("SIG-1", "Signature Requirements", "STANDARD", 1200, "ALL", PASS, VERIFY, [r"(?s)signature of appraiser|appraiser signature|APPRAISER\s+.*Signature|Date of Signature|Date Signed|signed", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"]),
    ("SIG-2", "Appraiser Information", "STANDARD", 1210, "ALL", VERIFY, VERIFY, [r"Name\s+[A-Z][A-Za-z]+|Appraiser\s+Name", r"Company\s+Name|Company\s+Address", r"State\s+Certification\s+#|State\s+License\s+#|License"]),
    ("SIG-3", "Supervisory Appraiser", "ADVISORY", 1220, "ALL", VERIFY, PASS, [r"(?s)SUPERVISORY APPRAISER.*(?:Name|Signature).{0,80}\S"]),
    ("SIG-4", "Email Address", "ADVISORY", 1230, "ALL", PASS, VERIFY, [r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"]),
    ("PH-1", "Required Subject Photos", "STANDARD", 1300, "ALL", PASS, VERIFY, [r"Subject\s+Front|Front\s+Exterior", r"Subject\s+Rear|Rear\s+Exterior", r"Subject\s+Street|Street\s+Scene"]),
    ("PH-2", "Interior Photos", "STANDARD", 1310, "ALL", PASS, VERIFY, [r"Subject\s+Kitchen|\bKitchen\b", r"Subject\s+Living\s+Room|\bLiving\s+Room\b", r"Subject\s+Bedroom|\bBedroom\b", r"Subject\s+Bath(?:room)?|\bBathroom\b"]),
    ("PH-3", "Additional Subject Photos", "STANDARD", 1320, "ALL", VERIFY, VERIFY, [r"outbuilding|pool|deferred maintenance|special feature|obsolescence|subject side|crawl|attic"]),
    ("PH-4", "FHA Specific Photo Requirements", "STANDARD", 1330, "FHA", PASS, VERIFY, [r"Left\s+Side|Subject\s+Side", r"Right\s+Side|Subject\s+Side", r"Attic", r"Crawl"]),
    ("PH-5", "Comparable Photos", "STANDARD", 1340, "ALL", VERIFY, VERIFY, [r"comparable photo|comp(?:arable)?\s+\d|MLS photo|drive-?by|Comparable\s+Sale\s+#"]),
    ("PH-6", "Obsolescence Photo Requirements", "ADVISORY", 1350, "ALL", VERIFY, PASS, [r"obsolescence|external factor|deferred maintenance|damage"]),
    ("M-1", "Location Map", "STANDARD", 1400, "ALL", PASS, VERIFY, [r"location map|subject.*comparables|comparable.*map"]),
    ("M-2", "Aerial Map", "ADVISORY", 1410, "ALL", PASS, VERIFY, [r"aerial map|aerial view|satellite"]),
    ("SK-1", "Sketch Location", "STANDARD", 1500, "ALL", PASS, VERIFY, [r"floor plan|sketch|building sketch|ANSI standards|measured per ANSI"]),
    ("SK-2", "Floor Coverage", "STANDARD", 1510, "ALL", VERIFY, VERIFY, [r"first floor|second floor|main level|basement|upper level|lower level|one[-\s]?story|#\s*of\s*Stories\s+1"]),
    ("SK-3", "Dimensions", "STANDARD", 1520, "ALL", PASS, VERIFY, [r"""\d+(?:\.\d+)?\s*[xX]\s*\d+(?:\.\d+)?|\d+'\s*-\s*\d+"|measured per ANSI|ANSI standards"""]),
    ("SK-4", "Outbuildings and Structures", "STANDARD", 1530, "ALL", VERIFY, VERIFY, [r"garage|outbuilding|porch|deck|patio|balcony|pool"]),
    ("SK-5", "Area Calculations", "STANDARD", 1540, "ALL", VERIFY, VERIFY, [r"gross living area|GLA|area calculation|total area"]),
    ("FHA-2", "FHA Case Number", "BLOCKING", 1610, "FHA", PASS, FAIL, [r"\bFHA Case (?:No\.?|Number)\b.*\d{3}-\d{7}"]),
    ("FHA-3", "FHA Intended Use and Intended User", "BLOCKING", 1620, "FHA", VERIFY, VERIFY, [r"intended use|intended user|HUD|FHA"]),
    ("FHA-6", "FHA Repairs", "STANDARD", 1650, "FHA", VERIFY, VERIFY, [r"subject to repairs?|required repair|defective|safety"]),
    ("FHA-7", "Space Heater as Primary Heat", "STANDARD", 1660, "FHA", VERIFY, PASS, [r"space heater"]),
    ("FHA-8", "Security Bars on Windows", "STANDARD", 1670, "FHA", VERIFY, PASS, [r"security bars?|release latch"]),
    ("FHA-10", "Estimated Remaining Economic Life", "STANDARD", 1690, "FHA", PASS, VERIFY, [r"remaining economic life.*(?:\d+)"]),
    ("FHA-11", "Attic/Crawl Space Inspection", "STANDARD", 1700, "FHA", VERIFY, VERIFY, [r"attic|crawl space"]),
    ("FHA-12", "Well and Septic (FHA)", "STANDARD", 1710, "FHA", VERIFY, PASS, [r"well|septic"]),
    ("USDA-1", "Cost Approach", "STANDARD", 1800, "USDA", PASS, FAIL, [r"cost approach"]),
    ("MF-1", "Subject Rent Matching", "STANDARD", 1810, "ALL", VERIFY, VERIFY, [r"gross monthly rent|subject rent schedule|1007"]),
    ("MF-2", "Operating Income Statement (Form 216)", "STANDARD", 1820, "ALL", PASS, VERIFY, [r"form\s*216|operating income statement"]),
]

# fixed values: rules that always ask for a look
MANUAL_RULES = [
    ("SCA-23", "Listing Comparables", "ADVISORY", 820, "ALL"), ("SCA-24", "Unique Design Properties", "ADVISORY", 830, "ALL"), ("SCA-26", "Square Footage", "ADVISORY", 850, "ALL"),
    ("FHA-1", "HUD Minimum Property Requirements", "BLOCKING", 1600, "FHA"), ("FHA-4", "FHA Minimum Property Requirements Statement", "STANDARD", 1630, "FHA"), ("FHA-5", "FHA Comparable Sales Dating", "STANDARD", 1640, "FHA"),
    ("FHA-9", "FHA Photo Requirements", "STANDARD", 1680, "FHA"), ("FHA-13", "FHA Appliances", "STANDARD", 1720, "FHA"), ("FHA-14", "FHA Sketch Requirements", "STANDARD", 1730, "FHA"),
]

# fixed values: rules on a field of every comparable. id, name, severity, order, field, pattern of text that stands in
# for a missing field, status of that, pattern that a present field must fit (or none), status where it doesn't
COMPARABLE_RULES = [
    ("SCA-4", "Proximity to Subject", "STANDARD", 630, "proximity", r"\b\d+(?:\.\d+)?\s*(?:miles?|mi)\s*(?:N|S|E|W|NE|NW|SE|SW)\b", PASS, r"(?i)\b\d+(?:\.\d+)?\s*(?:mi|miles?)\s*(?:N|S|E|W|NE|NW|SE|SW)\b", FAIL),
    ("SCA-5", "Data Sources", "STANDARD", 640, "data_source", r"MLS#?\s*\d+.*DOM\s*\d+|DOM\s*\d+", PASS, r"(?i)DOM", VERIFY),
    ("SCA-6", "Verification Sources", "STANDARD", 650, "verification_source", r"Verification\s+Source\(s\)|Tax\s+Records?|Previous\s+Appraisal|Tax\s+Cards", PASS, None, None),
    ("SCA-8", "Date of Sale/Time Adjustment", "STANDARD", 670, "sale_date", r"\b(?:s|c)\d{2}/\d{2};c\d{2}/\d{2}|Date\s+of\s+Sale/Time", VERIFY, None, None),
    ("SCA-9", "Location Rating", "ADVISORY", 680, "location_rating", r"\bN;Res;|\bB;|\bA;|\bAdj", PASS, r";", FAIL),
    ("SCA-11", "Site", "STANDARD", 700, "site_size", r"\b\d[\d,]*\s*sf\b|\b\d+(?:\.\d+)?\s*ac\b", PASS, None, None),
    ("SCA-14", "Quality of Construction", "STANDARD", 730, "quality_rating", r"(?-i)\bQ[1-6]\b", PASS, r"(?i)^Q[1-6]$", FAIL),
    ("SCA-15", "Actual Age", "STANDARD", 740, "actual_age", r"Actual\s+Age\s+\d+|\bAge\s+\d+", PASS, None, None),
    ("SCA-16", "Condition", "STANDARD", 750, "condition_rating", r"(?-i)\bC[1-6]\b", PASS, r"(?i)^C[1-6]$", FAIL),
    ("SCA-21", "Garage/Carport", "STANDARD", 800, "garage_carport", r"Garage/Carport|2ga2dw|garage", PASS, None, None),
]


def _text_status(found: str, not_found: str, patterns: list[str]) -> Callable[[Doc], Column]:
    def status(d: Doc) -> Column:
        test = F.lit(True)
        for p in patterns:
            test = test & d.has(p)
        return F.when(test, found).otherwise(not_found)

    return status


def _comparable_status(field: str, evidence: str, then: str, form: str | None, misfit: str | None) -> Callable[[Doc], Column]:
    def status(d: Doc) -> Column:
        out = F.when(d.comps_lack(field), F.when(d.has(evidence), then).otherwise(VERIFY))
        return (out.when(d.comps_fail(field, form), misfit) if form else out).otherwise(PASS)

    return status


for _id, _name, _sev, _order, _loans, _yes, _no, _patterns in TEXT_RULES:
    register(Rule(_id, _name, _sev, _order, _loans, _text_status(_yes, _no, _patterns)))
for _id, _name, _sev, _order, _loans in MANUAL_RULES:
    register(Rule(_id, _name, _sev, _order, _loans, lambda d: F.lit(VERIFY)))
for _id, _name, _sev, _order, _field, _evidence, _then, _form, _misfit in COMPARABLE_RULES:
    register(Rule(_id, _name, _sev, _order, "ALL", _comparable_status(_field, _evidence, _then, _form, _misfit)))


def is_refinance(d: Doc) -> Column:
    return F.lower(F.coalesce(d("assignment_type"), F.lit(""))).contains("refinance")


def or_else(status: Column) -> Column:
    return F.coalesce(status, F.lit(PASS))


@rule("S-1", "Property Address Validation", "BLOCKING", 10)
def property_address(d: Doc) -> Column:
    """Street nearly, city, state, five digits of the zip and (where the letter names one) county alike.

    City, state and zip that the letter lacks are read off the end of its address line. A differing address that an
    answer in ``llm_address`` holds to be the same place with confidence 0.75 asks for a look.
    """
    line = F.trim(F.split(d("letter.property_address"), r"(?i)\bProperty\s+County\b").getItem(0))
    part = lambda i: F.nullif(F.regexp_extract(line, r"^(.+?)\s+([A-Za-z\s]+?),?\s+([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$", i), F.lit(""))
    given = [F.nullif(F.trim(d(f"letter.{f}")), F.lit("")) for f in ("city", "state", "zip_code")]
    street = F.when(given[0].isNull() | given[1].isNull() | given[2].isNull(), F.coalesce(part(1), line)).otherwise(line)
    city, state, zip_code = (F.coalesce(g, part(i)) for g, i in zip(given, (2, 3, 4), strict=True))
    a, b = street_tokens(d("subject.address")), street_tokens(street)
    x, y = F.array_join(a, " "), F.array_join(b, " ")
    near = (sequence_ratio(x, y) >= 0.85) | F.contains(x, y) | F.contains(y, x) | same_street(a, b)
    alike = lambda mine, theirs: (mine != "") & (mine == theirs)
    county = F.coalesce(upper_key(d("letter.county")), F.lit(""))
    same = [
        near, alike(upper_key(d("subject.city")), upper_key(city)), alike(F.upper(F.trim(d("subject.state"))), F.upper(F.trim(state))),
        alike(F.left(d("subject.zip_code"), F.lit(5)), F.left(zip_code, F.lit(5))), (county == "") | (upper_key(d("subject.county")) == county),
    ]
    passed = F.lit(True)
    for test in same:
        passed = passed & F.coalesce(test, F.lit(False))
    said = d("llm_address.same_location", "boolean") & (d("llm_address.confidence", "double") >= 0.75)
    return F.when(d.any_null("subject.address", "letter.property_address"), VERIFY).when(passed, PASS).when(F.coalesce(said, F.lit(False)), VERIFY).otherwise(FAIL)


@rule("S-2", "Borrower Name Validation", "BLOCKING", 20)
def borrower_name(d: Doc) -> Column:
    name = lambda p: upper_key(F.split(d(p), r"(?i)\b(?:owner of public record|county|legal description)\b").getItem(0))
    b, l, o = (F.trim(name(p)) for p in ("subject.borrower", "letter.borrower_name", "subject.owner_of_public_record"))
    return F.when(d.any_null("subject.borrower", "letter.borrower_name"), VERIFY).when(b != l, FAIL).when(is_refinance(d) & o.isNotNull() & (o != b), VERIFY).otherwise(PASS)


@rule("S-3", "Owner of Public Record", "STANDARD", 30)
def public_owner(d: Doc) -> Column:
    differs = F.trim(upper_key(d("subject.owner_of_public_record"))) != F.trim(upper_key(d("subject.borrower")))
    return F.when(d.blank("subject.owner_of_public_record"), FAIL).when(is_refinance(d) & ~d.blank("subject.borrower") & differs, VERIFY).otherwise(PASS)


@rule("S-4", "Legal Description and Taxes", "STANDARD", 40)
def legal_and_taxes(d: Doc) -> Column:
    year, taxes = d("subject.tax_year").try_cast("int"), d("subject.real_estate_taxes").try_cast("double")
    return F.when(d.any_null("subject.legal_description", "subject.apn", "subject.tax_year", "subject.real_estate_taxes"), VERIFY).when(year.isNull() | (year < d.as_of_year - 2) | (taxes % 1 != 0), FAIL).otherwise(PASS)


@rule("S-5", "Neighborhood Name", "STANDARD", 50)
def neighborhood_name(d: Doc) -> Column:
    empty = F.upper(F.trim(d("subject.neighborhood_name"))).isin("NONE", "N/A", "NA", "UNKNOWN", "NOT APPLICABLE", "N.A.", "BLANK")
    return F.when(d.blank("subject.neighborhood_name") | empty, FAIL).otherwise(PASS)


@rule("S-6", "Map Reference and Census Tract", "STANDARD", 60)
def map_and_census(d: Doc) -> Column:
    return F.when(d.any_null("subject.map_reference", "subject.census_tract"), VERIFY).when(~F.trim(d("subject.census_tract")).rlike(r"^\d{4}(\.\d{2})?$"), FAIL).otherwise(PASS)


@rule("S-7", "Occupant Status", "STANDARD", 110)
def occupant(d: Doc) -> Column:
    s = F.upper(F.trim(d("subject.occupant_status")))
    lease = d.any_null("subject.lease_dates") | d.any_null("subject.rental_amount")
    return F.when(d.blank("subject.occupant_status"), FAIL).when(~s.isin("OWNER", "TENANT", "VACANT", "OWNER OCCUPIED"), FAIL).when((s == "TENANT") & lease, VERIFY).when((s == "VACANT") & d("subject.utilities_on").isNull(), VERIFY).otherwise(PASS)


@rule("S-8", "Special Assessments", "STANDARD", 120)
def special_assessments(d: Doc) -> Column:
    v = d("subject.special_assessments", "double")
    return or_else(F.when(v.isNull(), VERIFY).when((v > 0) & d.short("subject.special_assessments_comment", 10), FAIL))


@rule("S-9", "PUD and HOA", "STANDARD", 130)
def pud_and_hoa(d: Doc) -> Column:
    dues, pud = d("subject.hoa_dues", "double"), F.coalesce(d("subject.is_pud", "boolean"), F.lit(False))
    return or_else(F.when((dues > 0) & ~pud, FAIL).when((dues > 0) & d.blank("subject.hoa_period"), VERIFY))


@rule("S-10", "Lender/Client Information", "STANDARD", 140)
def lender(d: Doc) -> Column:
    up = lambda p: F.upper(F.trim(d(p)))
    return (
        F.when(d.blank("letter.lender_name") & d.blank("letter.lender_address"), VERIFY)
        .when(~d.blank("letter.lender_name") & d.blank("subject.lender_name"), VERIFY)
        .when(up("letter.lender_name") != up("subject.lender_name"), FAIL)
        .when(up("letter.lender_address") != up("subject.lender_address"), FAIL)
        .otherwise(PASS)
    )


@rule("S-11", "Property Rights Appraised", "STANDARD", 150)
def property_rights(d: Doc) -> Column:
    ok = F.upper(F.trim(d("subject.property_rights"))).isin("FEE SIMPLE", "LEASEHOLD", "DE MINIMIS PUD", "LEASEHOLD INTEREST")
    return F.when(d.blank("subject.property_rights"), VERIFY).when(~ok, FAIL).otherwise(PASS)


@rule("S-12", "Prior Listing/Sale History", "ADVISORY", 160)
def prior_listing(d: Doc) -> Column:
    offered = d("subject.offered_for_sale_12mo", "boolean")
    lacks = d.any_null("subject.mls_number", "subject.days_on_market", "subject.list_price", "subject.list_date")
    return or_else(F.when(offered.isNull() | d.short("subject.data_source", 2), FAIL).when(offered & lacks, VERIFY))


@rule("C-1", "Contract Analysis Requirement", "BLOCKING", 70, "Purchase")
def contract_analysis(d: Doc) -> Column:
    done = d("contract.did_analyze_contract", "boolean")
    refi = F.when(d("contract.contract_price").isNotNull(), FAIL).otherwise(PASS)
    return F.when(is_refinance(d), refi).when(done.isNull(), VERIFY).when(~done, FAIL).when(d.short("contract.analysis_comment", 20) | d.blank("contract.sale_type"), VERIFY).otherwise(PASS)


@rule("C-2", "Contract Price and Date", "BLOCKING", 80, "Purchase")
def contract_price(d: Doc) -> Column:
    price, agreed = d("contract.contract_price", "double"), d("agreement.contract_price", "double")
    dates = parse_date_or_text(d("contract.contract_date")) != parse_date_or_text(d("agreement.contract_date"))
    return or_else(F.when(is_refinance(d), PASS).when(price.isNull(), VERIFY).when(price != agreed, FAIL).when(dates, FAIL))


@rule("C-3", "Owner of Record Data Source", "STANDARD", 90, "Purchase")
def owner_source(d: Doc) -> Column:
    owner = d("contract.is_seller_owner", "boolean")
    return or_else(F.when(is_refinance(d), PASS).when(owner.isNull(), VERIFY).when(d.short("contract.owner_record_data_source", 2), FAIL).when(~owner & d.short("contract.owner_record_commentary", 10), FAIL))


@rule("C-4", "Financial Assistance", "STANDARD", 170, "Purchase")
def assistance(d: Doc) -> Column:
    yes, amount, agreed = d("contract.financial_assistance", "boolean"), d("contract.financial_assistance_amount", "double"), d("agreement.concessions_amount", "double")
    none = d.has(r"\$0\s*;?;?\s*(?:closing costs?|concessions?)") | ((F.abs(F.coalesce(agreed, F.lit(1.0))) < 0.01) & (F.abs(F.coalesce(amount, F.lit(0.0))) < 0.01))
    return or_else(F.when(is_refinance(d), PASS).when(yes.isNull(), VERIFY).when(~yes & (amount > 0), FAIL).when(~yes, PASS).when(none, PASS).when(F.coalesce(amount, F.lit(0.0)) <= 0, VERIFY).when(d.short("contract.financial_assistance_description", 5), FAIL).when(F.abs(amount - agreed) > 0.01, FAIL))


# fixed values: wording of a contract that names no item
BOILERPLATE = [
    "firewood shall not be considered debris", "property to be delivered in clean condition", "property being sold as-is", "property is being sold as-is",
    "of the otherwise identified in this agreement as remaining with the property",
]


def real_items(items: Column) -> Column:
    """Items with single spaces and without outer marks, less empty ones and contract boilerplate."""
    clean = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ .;:,]+|[ .;:,]+$", ""))
    wording = "|".join(BOILERPLATE) + r"|\b(?:as-is|debris|clean condition|otherwise identified in this agreement)\b"
    return F.coalesce(F.filter(clean, lambda x: (x != "") & ~F.lower(x).rlike(wording)), F.array().cast("array<string>"))


@rule("C-5", "Personal Property Analysis", "ADVISORY", 180, "Purchase")
def personal_property(d: Doc) -> Column:
    """Every item of the agreement is in the comment, which says what it contributes; the report's own items say so too."""
    items, own = real_items(d("agreement.personal_property_items", "array<string>")), real_items(d("contract.personal_property_items", "array<string>"))
    comment = F.upper(F.coalesce(d("contract.sales_concessions_comment"), d("contract.personal_property_comment"), F.lit("")))
    lacks = F.exists(items, lambda x: ~F.contains(comment, F.upper(x))) | ~comment.rlike("CONTRIBUTE|VALUE|CONTRIBUTORY")
    return (
        F.when(is_refinance(d), PASS).when((F.size(items) > 0) & (F.length(F.trim(comment)) < 10), FAIL).when((F.size(items) > 0) & lacks, VERIFY)
        .when((F.size(own) > 0) & d("contract.personal_property_contributes_to_value", "boolean").isNull(), VERIFY).otherwise(PASS)
    )


def complete(id_: str, name: str, order: int, *fields: str, severity: str = "STANDARD") -> None:
    register(Rule(id_, name, severity, order, "ALL", lambda d: F.when(d.any_null(*fields), VERIFY).otherwise(PASS)))


complete("N-1", "Neighborhood Characteristics", 190, "neighborhood.location", "neighborhood.built_up", "neighborhood.growth_rate")
complete("N-2", "Housing Trends", 192, "neighborhood.property_values", "neighborhood.demand_supply", "neighborhood.marketing_time")
complete("I-7", "Above Grade Room Count", 460, "improvements.total_rooms", "improvements.bedrooms", "improvements.baths", "improvements.gla")


@rule("N-3", "One-Unit Housing Price Range", "ADVISORY", 194)
def price_range(d: Doc) -> Column:
    low, high = d("neighborhood.price_low", "double"), d("neighborhood.price_high", "double")
    priced = F.exists(d.comps, lambda c: c["sale_price"].isNotNull()) if "sale_price" in d.comp_fields() else F.lit(False)
    return F.when(low.isNull() | high.isNull(), VERIFY).when(low > high, FAIL).when(~priced, VERIFY).otherwise(PASS)


@rule("N-4", "Present Land Use Total", "ADVISORY", 196)
def land_use(d: Doc) -> Column:
    total, other = d("neighborhood.land_use_total", "double"), F.regexp_extract(d.text, r"(?i)Other\s+(\d{1,3})\s*%", 1).try_cast("int")
    explained = F.coalesce(d("neighborhood.description"), F.lit("")).rlike(r"(?i)(?s)other.*(?:land|use|vacant|park|agric|commercial)")
    return or_else(F.when(total.isNull(), VERIFY).when(F.abs(total - 100) > 1, FAIL).when((other > 0) & ~explained, VERIFY))


@rule("N-5", "Neighborhood Boundaries", "STANDARD", 198)
def boundaries(d: Doc) -> Column:
    up = F.upper(d("neighborhood.boundaries"))
    lacks = F.exists(F.array(*[F.lit(x) for x in ("NORTH", "SOUTH", "EAST", "WEST")]), lambda x: ~F.contains(up, x))
    return F.when(d.short("neighborhood.boundaries", 5), VERIFY).when(lacks, FAIL).otherwise(PASS)


@rule("N-6", "Neighborhood Description Present", "STANDARD", 200)
def description(d: Doc) -> Column:
    return F.when(d.short("neighborhood.description", 10), VERIFY).otherwise(PASS)


@rule("N-7", "Market Conditions Present", "STANDARD", 202)
def market_conditions(d: Doc) -> Column:
    c = F.upper(F.coalesce(d("neighborhood.market_conditions"), F.lit("")))
    return F.when(d.short("neighborhood.market_conditions", 5), VERIFY).when(c.contains("SEE 1004MC") & (F.length(c) < 15), FAIL).otherwise(PASS)


def field_or_text(id_: str, name: str, severity: str, order: int, field: str, pattern: str, otherwise: str = VERIFY) -> None:
    register(Rule(id_, name, severity, order, "ALL", lambda d: F.when(d.blank(field) & ~d.has(pattern), otherwise).otherwise(PASS)))


field_or_text("ST-2", "Site Area", "STANDARD", 310, "site.area", r"\bArea\s+[\d,.]+\s*(?:sf|sq\.?\s*ft|ac)")
field_or_text("ST-3", "Site Shape", "STANDARD", 320, "site.shape", r"\bShape\s+[A-Za-z]+")
field_or_text("ST-4", "View", "ADVISORY", 330, "site.view", r"\bView\s+[A-Z];[A-Za-z]+")
field_or_text("I-2", "Foundation", "STANDARD", 410, "improvements.foundation_type", r"Concrete\s+Slab|Crawl\s+Space|Basement|Foundation")
field_or_text("I-5", "Utilities", "STANDARD", 440, "subject.utilities_on", r"utilities?\s+(?:and appliances\s+)?(?:were\s+)?(?:on|off)|all utilities.*were on", FAIL)


@rule("ST-1", "Site Dimensions", "STANDARD", 300)
def site_dimensions(d: Doc) -> Column:
    dims = F.coalesce(d("site.dimensions"), F.nullif(F.regexp_extract(d.text, r"(?i)Dimensions\s+([0-9.' xX]+)", 1), F.lit("")))
    odd = F.lower(d("site.shape")).contains("irregular") & ~d.has("plat|survey")
    same = F.abs(F.trim(dims).try_cast("double") - F.regexp_replace(d("site.area"), "[^0-9.]", "").try_cast("double")) <= 0.01
    return or_else(F.when(dims.isNull() | (F.trim(dims) == ""), VERIFY).when(odd | same, VERIFY))


@rule("ST-5", "Zoning Classification and Compliance", "STANDARD", 340)
def zoning(d: Doc) -> Column:
    z = F.lower(F.coalesce(d("site.zoning_compliance"), F.lit("")))
    return F.when(z.contains("illegal"), FAIL).when(z.contains("non") | z.contains("no zoning") | (z == ""), VERIFY).otherwise(PASS)


@rule("ST-6", "Highest and Best Use", "BLOCKING", 350)
def best_use(d: Doc) -> Column:
    said = F.lower(F.regexp_extract(d.text, r"(?i)highest and best use.{0,200}?\b(Yes|No)\b", 1))
    use = F.coalesce(d("site.highest_best_use", "boolean"), F.when(said == "yes", True).when(said == "no", False))
    return F.when(use.isNull(), VERIFY).when(~use, FAIL).otherwise(PASS)


@rule("ST-7", "Utilities and Off-Site Improvements", "STANDARD", 360)
def site_utilities(d: Doc) -> Column:
    flags = [F.coalesce(d(f"site.{u}", "boolean"), F.lit(False)) for u in ("electricity", "gas", "water", "sewer")]
    return F.when(flags[0] | flags[1] | flags[2] | flags[3] | d.has(r"\b(?:electricity|gas|water|sanitary sewer)\b"), PASS).otherwise(VERIFY)


@rule("ST-8", "FEMA Flood Hazard Area", "STANDARD", 370)
def flood_hazard(d: Doc) -> Column:
    return F.when(F.coalesce(d("site.fema_flood_hazard", "boolean"), F.lit(False)), VERIFY).when(d.blank("site.flood_zone") & ~d.has("FEMA|FLOOD"), VERIFY).otherwise(PASS)


@rule("ST-9", "Utilities Typical for Market", "STANDARD", 380)
def typical_utilities(d: Doc) -> Column:
    return F.when(d.has(r"utilities.{0,80}typical.{0,80}\bYes\b", dot_all=True), PASS).otherwise(VERIFY)


@rule("ST-10", "Adverse Site Conditions", "STANDARD", 390)
def adverse_site(d: Doc) -> Column:
    return F.when(F.coalesce(d("site.adverse_conditions", "boolean"), F.lit(False)), VERIFY).when(~d.has("easement|encroachment|environmental condition|adverse site"), VERIFY).otherwise(PASS)


@rule("I-1", "General Description", "STANDARD", 400)
def general_description(d: Doc) -> Column:
    lacks = [(f"improvements.{f}", p) for f, p in (("units_count", r"\bUnits?\b.*(?:One|1)"), ("design_style", r"Design\s*\(Style\)\s+[A-Za-z]"), ("year_built", r"Year\s+Built\s+\d{4}"), ("effective_age", r"Effective\s+Age\s*\(Yrs\)?\s*\d+"))]
    test = F.lit(False)
    for f, p in lacks:
        test = test | (d.blank(f) & ~d.has(p))
    return F.when(test, VERIFY).otherwise(PASS)


@rule("I-3", "Exterior Description", "STANDARD", 420)
def exterior(d: Doc) -> Column:
    return F.when((d.blank("improvements.exterior_walls") & ~d.has(r"Exterior\s+Walls?\s+[A-Za-z]")) | (d.blank("improvements.roof_surface") & ~d.has(r"Roof\s+Surface\s+[A-Za-z]")), VERIFY).otherwise(PASS)


@rule("I-9", "Property Condition Rating", "STANDARD", 480)
def condition(d: Doc) -> Column:
    found = F.coalesce(F.nullif(F.trim(d("improvements.condition_rating")), F.lit("")), F.nullif(F.regexp_extract(d.text, r"(?is)Condition.*?\b(C[1-6])\b", 1), F.lit("")))
    return F.when(F.coalesce(F.upper(found).rlike("^C[1-6]$"), F.lit(False)), PASS).otherwise(FAIL)


@rule("I-10", "Adverse Conditions Affecting Livability", "ADVISORY", 490)
def livability(d: Doc) -> Column:
    return F.when(F.coalesce(d("improvements.adverse_conditions", "boolean"), F.lit(False)), VERIFY).when(~d.has(r"adverse conditions.*(?:Yes|No)|livability|soundness|structural integrity", dot_all=True), VERIFY).otherwise(PASS)


@rule("I-11", "Neighborhood Conformity", "STANDARD", 500)
def conformity(d: Doc) -> Column:
    ok = d("improvements.conforms_to_neighborhood", "boolean")
    return F.when(~ok, VERIFY).when(ok.isNull() & ~d.has(r"conform to the neighborhood.*(?:Yes|No)|property generally conform", dot_all=True), VERIFY).otherwise(PASS)


def market_counts(d: Doc) -> tuple[Column, Column]:
    read = lambda p: F.regexp_extract(d.text, p, 1).try_cast("int")
    sales = F.coalesce(d("sales.count_sales", "int"), read(r"(?i)There\s+are\s+(\d+)\s+comparable\s+sales"))
    return sales, F.coalesce(d("sales.count_listings", "int"), read(r"(?i)There\s+are\s+(\d+)\s+comparable\s+properties\s+currently\s+offered"))


@rule("SCA-1", "Comparable Market Summary", "STANDARD", 600)
def market_summary(d: Doc) -> Column:
    sales, listings = market_counts(d)
    return F.when(sales.isNull() | listings.isNull(), VERIFY).otherwise(PASS)


@rule("SCA-2", "Comparables Required", "BLOCKING", 610)
def comparables_required(d: Doc) -> Column:
    sales, listings = market_counts(d)
    return F.when(sales.isNull(), VERIFY).when(sales < 3, FAIL).when(listings.isNull(), VERIFY).when(listings < 2, FAIL).otherwise(PASS)


@rule("SCA-3", "Address (Subject and Comparables)", "BLOCKING", 620)
def comparable_addresses(d: Doc) -> Column:
    return F.when(d.blank("subject.address") | d.comps_lack("address"), VERIFY).otherwise(PASS)


@rule("SCA-17", "Above Grade Room Count and GLA", "STANDARD", 760)
def comparable_rooms(d: Doc) -> Column:
    """Without comparables there is none that lacks a count."""
    if d.comps is None:
        return F.lit(PASS)
    names = set(d.comp_fields())
    lacks = lambda c: F.greatest(*[(c[f].isNull() if f in names else F.lit(True)).cast("int") for f in ("room_count_total", "room_count_bed", "room_count_bath", "gla")]) == 1
    return F.when(F.exists(d.comps, lacks), VERIFY).otherwise(PASS)


@rule("CA-1", "Cost Approach Requirement", "STANDARD", 950, "USDA")
def cost_required(d: Doc) -> Column:
    return F.when(d.has(r"\bUSDA\b|rural development") & ~d.has("cost approach"), FAIL).otherwise(VERIFY)


@rule("ADD-1", "Commentary Standards", "STANDARD", 1000)
def commentary_standards(d: Doc) -> Column:
    return F.when(~d.has("addendum|comments?|sales comparison|reconciliation"), VERIFY).when(d.has("typical for the area|no adverse conditions were noted|see attached addendum"), VERIFY).otherwise(PASS)


@rule("ADD-2", "Comparable Selection Commentary", "STANDARD", 1010)
def selection_commentary(d: Doc) -> Column:
    said = F.coalesce(F.nullif(d("sales.summary_commentary"), F.lit("")), d.text)
    return F.when(said.rlike("(?i)selected because|selected based on|most similar|proximity|bracket"), PASS).otherwise(VERIFY)


@rule("ADD-8", "1004MC Condo/Co-Op", "STANDARD", 1070)
def condo(d: Doc) -> Column:
    return F.when(F.coalesce(d("form_type") == "1073", F.lit(False)) | d.has("condo|co-?op"), VERIFY).otherwise(PASS)


@rule("M-3", "Plat Map", "STANDARD", 1420)
def plat_map(d: Doc) -> Column:
    regular = ~d.blank("site.dimensions") & ~d.blank("site.shape") & ~F.lower(F.coalesce(d("site.shape"), F.lit(""))).contains("irregular")
    return F.when(regular | d.has("plat map|survey|site plan"), PASS).otherwise(VERIFY)


@rule("M-4", "Flood Map", "STANDARD", 1430)
def flood_map(d: Doc) -> Column:
    map_ = d.has("flood map|FEMA map|flood hazard")
    return F.when(map_, PASS).when(F.coalesce(d("site.fema_flood_hazard", "boolean"), F.lit(False)), FAIL).otherwise(VERIFY)


# fixed values: wording of commentary
CANNED = [
    "the subject property is located in a", "the neighborhood is characterized by", "the subject is typical for the neighborhood", "see attached addendum", "no adverse conditions were noted",
    "the property appears to be in average condition", "no apparent adverse factors", "there are no apparent adverse factors", "there are no adverse factors", "the improvements are typical for the area",
    "the subject is compatible", "this is a stable neighborhood", "the market appears balanced", "see comparable sales grid", "adjustments reflect market reactions",
    "comparable sales were selected based on", "the cost approach was not developed", "the income approach was not developed", "equal weight was given to", "weighted average of the indicated values",
]
SPECIFIC = [
    r"\$[\d,]+", r"\d+\s*(?:sf|sq\.?\s*ft)", r"(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d+",
    r"\d+/\d+/\d+", r"\bDOM\s*\d+", r"\b[A-Z]{2,5}MLS\b", r"\d+%", r"\bMLS\b.*?\d+",
]
REASONS = ["because", "therefore", "as a result", "due to", "since", "based on", "indicates", "suggests", "reflects", "demonstrates", "specifically", "in comparison", "relative to", "taking into account", "given that"]
FINANCING = r"\b(?:fha|va|conventional|financing|loan)\b"
MEASURES = r"\b(?:absorption|inventory|active listings?|pending sales?|closed sales?|supply|demand|days on market|dom)\b"


def phrase_rule(id_: str, name: str, severity: str, order: int, field: str, phrases: str) -> None:
    register(Rule(id_, name, severity, order, "ALL", lambda d: F.when(d.short(field, 20), VERIFY).when(d(field).rlike("(?i)" + phrases), PASS).otherwise(VERIFY)))


@rule("COM-1", "Neighborhood Description Specificity", "ADVISORY", 2100)
def specificity(d: Doc) -> Column:
    """Stock phrases fail; an answer in ``llm_specific`` decides before the keywords, unless they deny adverse factors."""
    c, said = d("neighborhood.description"), d("llm_specific", "boolean")
    canned = commentary.canned(c, CANNED, SPECIFIC, REASONS)["canned"]
    denies = c.rlike(r"(?i)\bno\s+(?:apparent\s+)?adverse\s+factors?\b")
    return F.when(d.short("neighborhood.description", 30), VERIFY).when(canned & denies, FAIL).when(said, PASS).when(~said | canned, FAIL).otherwise(PASS)


@rule("COM-2", "Market Conditions Quality", "STANDARD", 2110)
def market_quality(d: Doc) -> Column:
    """Two facts pass; talk of financing alone and "see 1004MC" fail. ``llm_market`` holds see_1004mc and has_analysis."""
    c = d("neighborhood.market_conditions")
    facts = commentary.hits(c, SPECIFIC)
    financing = (F.regexp_count(F.lower(c), F.lit(FINANCING)) >= 2) & (facts == 0) & ~F.lower(c).rlike(MEASURES)
    refers = F.lower(c).rlike(r"see\s+1004mc|refer\s+to.*1004mc")
    analysis = d("llm_market.has_analysis", "boolean")
    return F.when(d.short("neighborhood.market_conditions", 10) | financing, FAIL).when(d("llm_market.see_1004mc", "boolean") & ~analysis, FAIL).when(analysis, PASS).when((facts >= 2) & ~refers, PASS).otherwise(FAIL)


@rule("COM-3", "Comparable Selection Rationale", "ADVISORY", 2120)
def selection_rationale(d: Doc) -> Column:
    sales, _ = market_counts(d)
    said = d("sales.summary_commentary").rlike("(?i)selected because|selected based on|most similar|proximity|bracket|similar in")
    return F.when(sales < 3, FAIL).when(d.short("sales.summary_commentary", 20), VERIFY).when(said, PASS).otherwise(VERIFY)


phrase_rule("COM-4", "Adjustments Explanation", "ADVISORY", 2130, "sales.summary_commentary", "adjust(?:ed|ment)")
phrase_rule("COM-5", "Reconciliation Sufficiency", "STANDARD", 2140, "sales.reconciliation_commentary", "most weight|greatest weight|weighted|reconcil|most reliable")


@rule("COM-6", "Addenda Consistency", "ADVISORY", 2150)
def addenda(d: Doc) -> Column:
    """The addenda name another address, borrower, lender or final value (``market_value_opinion``) than the form."""
    marks = lambda low: F.array_min(F.filter(F.array(*[F.instr(low, x) for x in ("addendum", "additional comments", "certification")]), lambda x: x > 0))
    of = lambda first: F.coalesce(F.substring(d.text, first, F.length(d.text)), F.right(d.text, F.lit(5000)))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    amount = F.regexp_replace(F.regexp_replace(d("market_value_opinion"), r"\.\d*$", ""), "[^0-9]", "")

    def issue(part: Column, key: Column) -> Column:
        lacks = lambda p: (F.coalesce(d(p), F.lit("")) != "") & ~F.contains(key, plain(d(p)))
        amounts = F.transform(F.regexp_extract_all(part, F.lit(r"\$\s*\d[\d,]{3,}"), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
        return (
            (lacks("subject.address") & part.rlike(r"\b\d{2,6}\s+[A-Za-z0-9 .'-]{3,80}\b")) | (lacks("subject.borrower") & part.rlike(r"(?i)\bborrower\b"))
            | (lacks("subject.lender_name") & part.rlike(r"(?i)\b(?:lender|client)\b")) | F.coalesce((amount != "") & let(amounts, lambda a: (F.size(a) > 0) & ~F.array_contains(a, amount)), F.lit(False))
        )

    differs = let(let(let(F.lower(d.text), marks), of), lambda part: let(plain(part), lambda key: issue(part, key)))
    return F.when(F.trim(d.text) == "", VERIFY).when(differs, VERIFY).otherwise(PASS)


@rule("COM-7", "Prior Sales Disclosure", "STANDARD", 2160)
def prior_sales(d: Doc) -> Column:
    offered = d("subject.offered_for_sale_12mo", "boolean")
    return or_else(F.when(offered.isNull(), VERIFY).when(offered & d.any_null("subject.days_on_market", "subject.data_source"), VERIFY))


def cross_field(d: Doc) -> dict[str, tuple[str, Column]]:
    """Checks that emit a row on a finding only: id to (name, status or null)."""
    dues, pud = d("subject.hoa_dues", "double"), F.coalesce(d("subject.is_pud", "boolean"), F.lit(False))
    trend = F.lower(F.coalesce(d("neighborhood.property_values"), F.lit(""))).rlike("increasing|declining")
    adjusted = d.has(r"(?:time|date)[^0-9\n]{0,40}[1-9]")
    low, high = d("neighborhood.price_low", "double"), d("neighborhood.price_high", "double")
    outside = F.exists(d.comps, lambda c: (c["sale_price"] < low) | (c["sale_price"] > high)) if "sale_price" in d.comp_fields() else F.lit(False)
    rating, age, actual = F.upper(d("improvements.condition_rating")), d("improvements.effective_age", "int"), d.as_of_year - d("improvements.year_built", "int")
    aged = ((rating == "C1") & (age > 5)) | (rating.isin("C5", "C6") & (age < 0.5 * actual))
    three_way = outcome(sequence_ratio(F.regexp_replace(F.lower(d("subject.address")), "[^a-z0-9]", ""), F.regexp_replace(F.lower(d("letter.property_address")), "[^a-z0-9]", "")), F.lit(0.99))
    fha = F.lower(F.coalesce(d("loan_type"), F.lit(""))).contains("fha") | d.text.contains("FHA")
    life = F.regexp_extract(d.text, r"(?i)remaining economic life\D{0,40}(\d{1,3})", 1).try_cast("int")
    numbered = lambda t: F.array_join(F.slice(F.split(F.trim(t), r"\s+"), 1, 80), " ").rlike(r"\b\d{3}-\d{7}\b")
    unnumbered = F.exists(F.col("pages"), lambda t: ~F.coalesce(numbered(t), F.lit(False))) if "pages" in d.schema.fieldNames() else ~d.has(r"\b\d{3}-\d{7}\b")
    effective = parse_date(F.regexp_extract(d.text, r"(?i)effective date[^0-9]{0,30}(\d{1,2}/\d{1,2}/\d{2,4})", 1), pivot=69)
    dated = F.exists(F.slice(d.comps, 1, 3), lambda c: F.datediff(effective, parse_date(c["sale_date"].cast("string"), pivot=69)) > 365) if "sale_date" in d.comp_fields() else F.lit(False)
    contract = F.lit(False)
    for f in ("contract_price", "contract_date", "sale_type", "did_analyze_contract"):
        contract = contract | ~d.blank(f"contract.{f}")
    return {
        "XF-1": ("Market trend and time adjustments", F.when(trend & ~adjusted, FAIL)),
        "XF-2": ("Comparable price outside the range", F.when(outside, VERIFY)),
        "XF-3": ("Condition and effective age", F.when(aged, VERIFY)),
        "XF-VIS-1": ("Reported and seen condition", F.when(rating.isin("C1", "C2") & F.upper(d("vision_condition")).isin("C4", "C5", "C6"), VERIFY)),
        "XF-4": ("Address against the letter", F.when(d("letter.property_address").isNotNull() & d("subject.address").isNotNull() & (three_way != PASS), three_way)),
        "XF-5": ("PUD and HOA", F.when((dues > 0) & ~pud, FAIL).when((dues == 0) & pud, VERIFY)),
        "XF-6": ("Contract section of a refinance", F.when(is_refinance(d) & contract, FAIL)),
        "XF-FHA-1": ("Case number on every page", F.when(fha & unnumbered, FAIL)),
        "XF-FHA-2": ("Comparables within a year", F.when(fha & dated, FAIL)),
        "XF-FHA-3": ("Remaining economic life", F.when(fha & (life < 30) & ~d.has("because|due to|explain"), FAIL)),
    }


def config(spark: SparkSession) -> DataFrame:
    """Default configuration: one row a rule."""
    rows = [(r.id, r.name, r.id.split("-")[0], True, r.severity, r.loans, r.order) for r in REGISTRY.values()]
    return spark.createDataFrame(rows, "rule_id string, rule_name string, rule_category string, is_active boolean, severity_level string, applicable_loan_types string, execution_order int")


def configured(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Defaults with the stored rows of an override table in their place, column by column."""
    cols = [c for c in defaults.columns if c != "rule_id"]
    o = overrides.select("rule_id", *[F.col(c).alias(f"o_{c}") for c in cols if c in overrides.columns])
    return defaults.join(o, "rule_id", "left").select("rule_id", *[F.coalesce(f"o_{c}", c).alias(c) if c in overrides.columns else F.col(c) for c in cols])


def applicable(loans: Column, loan_type: Column, assignment: Column) -> Column:
    """A rule for listed loan types runs on documents with such a type, or assignment, as a whole token."""
    return runs_on(loans, types_of(loan_type, assignment))


def types_of(loan_type: Column, assignment: Column) -> Column:
    return F.filter(F.split(F.upper(F.concat_ws(",", loan_type, assignment)), "[^A-Z0-9]+"), lambda t: t != "")


def runs_on(loans: Column, have: Column) -> Column:
    return loans.isNull() | F.array_contains(F.split(F.upper(loans), ","), "ALL") | F.arrays_overlap(F.split(F.upper(loans), ","), have)


def evaluate(docs: DataFrame, as_of_year: int, settings: DataFrame | None = None, rules: list[str] | None = None, cross: bool = True, evidence: Callable[[str], Column] | None = None) -> DataFrame:
    """Rows (doc_id, rule_id, rule_name, status, severity, execution_order, note), a row per document and rule.

    Inactive and inapplicable rules pass with a note. The configuration is a hundred-odd rows and is broadcast; each
    document is read once, its rules are one array of structs, a column before it is exploded, so that they are compiled. ``evidence`` gives a struct per rule id (see
    ``reports.evidence_of``), whose fields then follow.
    """
    low = "low"
    while low in docs.columns:
        low += "_"
    d = Doc(docs.schema, as_of_year, F.col(low))
    docs = docs.withColumn(low, folded(d.text))
    chosen = [r for r in REGISTRY.values() if rules is None or r.id in rules]
    found = [(r.id, r.status(d), False) for r in chosen] + ([(k, s, True) for k, (_, s) in cross_field(d).items()] if cross else [])
    more = (lambda k: []) if evidence is None else lambda k: [evidence(k).alias("evidence")]
    cells = [F.struct(F.lit(k).alias("rule_id"), s.alias("status"), F.lit(c).alias("cross"), *more(k)) for k, s, c in found]
    wide = docs.select("doc_id", types_of(d("loan_type"), d("assignment_type")).alias("have"), F.array(*cells).alias("cells"))
    # the array is never empty; a plain explode would test its size, and work out all rules, once more
    rows = wide.select("doc_id", "have", F.explode_outer("cells").alias("r")).select("doc_id", "have", "r.*").where("not cross or status is not null")
    settings = config(docs.sparkSession) if settings is None else settings
    joined = rows.join(F.broadcast(settings), "rule_id", "left")
    off = F.coalesce(~F.col("is_active"), F.lit(False))
    other = ~runs_on(F.col("applicable_loan_types"), F.col("have"))
    status = F.when(off | other, PASS).otherwise(F.coalesce("status", F.lit(VERIFY)))
    note = F.when(off, "disabled").when(other, "not applicable").when(F.col("status").isNull(), "data missing")
    return joined.select("doc_id", "rule_id", "rule_name", status.alias("status"), F.coalesce("severity_level", F.lit("STANDARD")).alias("severity"), F.coalesce("execution_order", F.lit(999)).alias("execution_order"), note.alias("note"), *(["evidence.*"] if evidence else []))
