"""The report compared with the engagement letter, field by field: what is missing, what differs, what needs a look.

A mechanical comparison in one projection, without a shuffle; rules decide what a difference means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.text import squeezed
from docgauge.plans.rules import Doc

# fixed values: compared fields in order: name, place in the report, place in the letter
PAIRS = [
    ("property_address", "subject.address", "letter.property_address"),
    ("city", "subject.city", "letter.city"),
    ("state", "subject.state", "letter.state"),
    ("zip_code", "subject.zip_code", "letter.zip_code"),
    ("county", "subject.county", "letter.county"),
    ("borrower_name", "subject.borrower", "letter.borrower_name"),
    ("co_borrower_name", "subject.co_borrower", "letter.co_borrower_name"),
    ("lender_name", "subject.lender_name", "letter.lender_name"),
    ("lender_address", "subject.lender_address", "letter.lender_address"),
    ("assignment_type", "contract.assignment_type", "letter.assignment_type"),
    ("contract_price", "contract.contract_price", "letter.contract_price"),
    ("concessions_amount", "contract.financial_assistance_amount", "letter.concessions_amount"),
]
AMOUNTS = {"contract_price", "concessions_amount"}


def amount(c: Column) -> Column:
    """A number as plain decimal text with one digit behind the point at least; 0 counts as absent."""
    return F.when(c != 0, F.regexp_replace(F.format_string("%.6f", c), r"(\.\d+?)0+$", "$1"))


def row(name: str, status: Column | str, report: Column | None = None, expected: Column | None = None, section: str | None = None, issue: str | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    kind = F.lit(status) if isinstance(status, str) else status
    return F.struct(F.lit(name).alias("field_name"), kind.alias("status"), text(report).alias("report_value"), text(expected).alias("expected_value"), F.lit(section).cast("string").alias("section"), F.lit(issue).cast("string").alias("issue"))


def pair(d: Doc, name: str, ours: str, theirs: str) -> Column:
    """MISSING where only the letter has a value, DIFFERENT where both have and they differ beyond case and white space."""
    kind = "double" if name in AMOUNTS else "string"
    a, b = d(ours, kind), d(theirs, kind)
    if name in AMOUNTS:
        a, b = amount(a), amount(b)
    if name == "contract_price":
        b = F.when(d("letter.assignment_type") == "Purchase", b)
    x, y = squeezed(a), squeezed(b)
    status = F.when(y.isNull(), None).when(x.isNull(), "MISSING").when(x != y, "DIFFERENT")
    return F.when(status.isNotNull(), row(name, status, a, b))


def flags(d: Doc) -> list[Column]:
    """What the report itself must explain, whatever the letter says of it."""
    rights, area, period = d("subject.property_rights"), d("subject.neighborhood_name"), d("subject.hoa_period")
    pud, offered, source = d("subject.is_pud", "boolean"), d("subject.offered_for_sale_12mo", "boolean"), d("subject.data_source")
    said = lambda c: F.coalesce(c != "", F.lit(False))
    pud_text = F.initcap(F.coalesce(pud.cast("string"), F.lit("none")))
    dated = said(d("contract.contract_date")) | F.coalesce(d("contract.contract_price", "double") != 0, F.lit(False))
    return [
        F.when(said(rights), row("property_rights", "PRESENT", rights, section="S-11")),
        F.when(d("subject.real_estate_taxes").isNull(), row("real_estate_taxes", "MISSING", section="S-4")),
        F.when(F.lower(F.coalesce(area, F.lit(""))).isin("n/a", "none", "unknown", ""), row("neighborhood_name", "MISSING", area, section="S-5")),
        F.when(said(period) & ~F.coalesce(pud, F.lit(False)), row("pud_hoa_consistency", "DIFFERENT", F.concat(F.lit("HOA period: "), period, F.lit(", PUD checked: "), pud_text), section="S-9", issue="hoa_period_without_pud")),
        F.when((d("letter.assignment_type") == "Refinance") & dated, row("contract_section_refinance", "DIFFERENT", F.lit("Contract section has data"), F.lit("Contract section should be blank for refinance"), "C-1")),
        F.when((offered == F.lit(False)) & ~said(source), row("listing_data_source", "MISSING", section="S-12", issue="no_data_source_for_12mo_history")),
    ]


def difference_report(docs: DataFrame) -> DataFrame:
    """(doc_id, position, field_name, status, report_value, expected_value, section, issue) of documents that have a letter.

    ``docs`` are rows as ``reports.assembled`` makes them; a part or field that the schema lacks is null. A null letter
    has no rows, a letter whose fields are all null still has the flags. Positions count a document's rows from 0.
    """
    d = Doc(docs.schema, 0)
    cells = F.array(*[pair(d, *p) for p in PAIRS], *flags(d))
    found = F.when(F.col("letter").isNotNull(), F.filter(cells, lambda c: c.isNotNull()))
    return docs.select("doc_id", F.posexplode(found).alias("position", "d")).select("doc_id", F.col("position"), "d.*")


def difference_summary(differences: DataFrame) -> DataFrame:
    """Documents and rows per field and status; a document has a field once."""
    return differences.groupBy("field_name", "status").agg(F.count("*").alias("n"))
