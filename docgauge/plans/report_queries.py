"""Queries of the path from page text to rule status, over stand-in pages that spell out a customer's stand-in fields.

Pages are text; the SQL states what must be read from them and then, in its own wording, what each rule must say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.functions.address_block import address_block
from docgauge.functions.value_stream import page_facts, page_stream
from docgauge.plans import fields, reports
from docgauge.plans.catalog import query
from docgauge.plans.rule_queries import SUBJECT, YEAR, none, when
from docgauge.sources.tables import spread, table

# stand-in facts of a report: expressions of k that both engines read alike
FACTS = {
    "address": "case k % 5 when 0 then null else '12 Oak Street' end",
    "city": "case k % 7 when 1 then 'Dallas' else 'Austin' end",
    "state": "case k % 11 when 0 then 'OK' else 'TX' end",
    "zip": "case k % 13 when 0 then '99999' else '78701-1234' end",
    "county": "case k % 4 when 0 then null when 1 then 'Hays' else 'Travis' end",
    "borrower": "case k % 6 when 0 then null when 1 then 'John Roe' else 'Jane Doe' end",
    "owner": "case k % 5 when 0 then null when 1 then 'John Roe' else 'Jane Doe' end",
    "legal": "case k % 7 when 0 then null else 'Lot 1' end",
    "apn": "case k % 8 when 0 then null else '1-2-3' end",
    "tax_year": "case k % 5 when 0 then '2019' else '2023' end",
    "taxes": "case k % 9 when 0 then null else '4,000' end",
    "area": "case k % 4 when 0 then null when 1 then 'Tax Year' when 2 then 'Unknown' else 'Sagecreek' end",
    "map": "case k % 5 when 0 then null else 'A1' end",
    "tract": "case k % 6 when 0 then null when 1 then '12.3' else '1234.56' end",
    "occupant": "case k % 4 when 0 then null when 1 then 'Tenant' when 2 then 'Vacant' else 'Owner' end",
    "assessments": "case k % 4 when 0 then null when 1 then '0' else '150' end",
    "dues": "case k % 4 when 0 then null when 1 then '0' else '120' end",
    "rights": "case k % 3 when 0 then null when 1 then 'Leasehold' else 'Fee Simple' end",
    "lender": "case k % 4 when 0 then null when 1 then 'Other Bank' else 'First Bank' end",
    "lender_address": "case k % 7 when 0 then '9 Else Rd' else '1 Main St' end",
    "mailed": "case k % 6 when 0 then null when 1 then 'PO Box 7777' else '12 oak street' end",
    "purchase": "k % 2 = 0",
}


def line(label: str, fact: str) -> str:
    return f"case when {fact} is not null then concat('{label}', {fact}, chr(10)) else '' end"


BOX = "concat('[', case when {0} then 'X' else ' ' end, '] {1}')"
#: Pages of a report and of its letter; the address comes in three layouts by k % 3.
PAGES = {
    ("report", 1): "concat('Summary report', chr(10), case when address is null then '' "
    "when k % 3 = 0 then concat('Property Address ', address, ' City ', city, ' State ', state, ' ZIP Code ', zip, chr(10)) "
    "when k % 3 = 1 then concat('Property Address', chr(10), chr(10), address, ' ', city, ' ', state, ' ', zip, chr(10)) "
    "else concat('Property Address: ', address, chr(10), 'City: ', city, chr(10), 'State: ', state, chr(10), 'Zip Code: ', zip, chr(10)) end, "
    + ", ".join([line("County ", "county"), line("Borrower ", "borrower"), line("Owner of Public Record ", "owner"), line("Legal Description ", "legal"), line("APN: ", "apn"), line("Tax Year ", "tax_year")])
    + ")",
    ("report", 2): "concat("
    + ", ".join([line("R.E. Taxes $ ", "taxes"), line("Neighborhood Name: ", "area"), line("Map Reference ", "map"), line("Census Tract ", "tract"), line("Special Assessments $", "assessments"), line("HOA $", "dues"), line("[X] ", "rights")])
    + f", case when occupant is null then '' else concat({', chr(59), '.join(BOX.format(f'occupant = {x!r}', x) for x in ('Owner', 'Tenant', 'Vacant'))}, chr(10)) end, "
    + line("Lender/Client: ", "lender")
    + ", "
    + line("Lender Address: ", "lender_address")
    + ")",
    ("report", 3): "concat('County Elsewhere', chr(10), 'Lender Address: 77 Far Rd', chr(10), 'Reconciliation and Occupant notes')",
    ("letter", 1): "concat(" + line("Property Address: ", "mailed") + ", 'City: Austin', chr(10), 'State: TX', chr(10), 'Zip Code: 78701', chr(10), 'Borrower Name: Jane Doe', chr(10), 'Client: First Bank', chr(10), 'Client Address: 1 Main St', chr(10), case when purchase then 'Purchase' else 'Refinance' end)",
}
IDS = ["S-1", "S-2", "S-3", "S-4", "S-5", "S-6", "S-7", "S-8", "S-9", "S-10", "S-11"]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, kind, page, text), four of a customer."""
    k = spread(table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", "c_custkey as k"), "doc_id")
    facts = k.select("doc_id", "k", *[F.expr(e).alias(n) for n, e in FACTS.items()])
    cells = [F.struct(F.lit(kind).alias("kind"), F.lit(page).alias("page"), F.expr(text).alias("text")) for (kind, page), text in PAGES.items()]
    return facts.select("doc_id", F.explode(F.array(*cells)).alias("p")).select("doc_id", "p.*")


# what must be read: a zip code that scattered parts lack, a label that is no value, a first page that has no county
READ = {
    "subject_address": "address", "subject_city": "case when address is not null then city end", "subject_state": "case when address is not null then state end", "subject_zip_code": "case when address is not null then zip end",
    "subject_county": "coalesce(county, 'Elsewhere')", "subject_borrower": "borrower", "subject_owner_of_public_record": "owner", "subject_legal_description": "legal", "subject_apn": "apn", "subject_tax_year": "tax_year",
    "subject_real_estate_taxes": "case when taxes is not null then 4000e0 end", "subject_neighborhood_name": "case when area = 'Tax Year' then null else area end", "subject_map_reference": "map", "subject_census_tract": "tract",
    "subject_occupant_status": "occupant", "subject_special_assessments": "cast(assessments as double)", "subject_hoa_dues": "cast(dues as double)", "subject_property_rights": "rights", "subject_lender_name": "lender",
    "subject_lender_address": "lender_address", "letter_property_address": "mailed", "letter_city": "'Austin'", "letter_state": "'TX'", "letter_zip_code": "'78701'", "letter_borrower_name": "'Jane Doe'", "letter_lender_name": "'First Bank'", "letter_lender_address": "'1 Main St'",
    "assignment_type": "case when purchase then 'Purchase' else 'Refinance' end", "loan_type": "'Conventional'",
}
ABSENT = ["letter_county", "subject_lease_dates", "subject_rental_amount", "subject_utilities_on", "subject_special_assessments_comment", "subject_hoa_period"]
DOCS = (
    "with facts as (select c_custkey as k, " + ", ".join(f"{e} as {n}" for n, e in FACTS.items()) + " from customer), d as (select k as doc_id, k, "
    + ", ".join(f"{e} as {n}" for n, e in READ.items()) + ", false as subject_is_pud, " + ", ".join(f"null::varchar as {n}" for n in ABSENT) + " from facts)"
)
# the page, value and confidence that each result must rest on: where its field stands, else the first page with a term
EVIDENCE = {
    "S-1": ("subject_address", "case when k % 3 = 2 then 0.80e0 else 0.85e0 end", "1", "case when subject_county = 'Elsewhere' then 3 else 1 end"), "S-2": ("subject_borrower", "0.88e0", "1", "null"), "S-3": ("subject_owner_of_public_record", "0.88e0", "1", "null"),
    "S-4": ("subject_legal_description", "0.88e0", "1", "1"), "S-5": ("subject_neighborhood_name", "0.88e0", "2", "case when k % 4 = 1 then 2 end"), "S-6": ("subject_census_tract", "case when k % 6 = 1 then 0.78e0 else 0.88e0 end", "2", "case when subject_map_reference is not null then 2 end"),
    "S-7": ("subject_occupant_status", "0.90e0", "2", "3"), "S-8": ("cast(subject_special_assessments as integer)::varchar", "0.88e0", "2", "null"), "S-9": ("cast(subject_hoa_dues as integer)::varchar", "0.78e0", "2", "null"),
    "S-10": ("subject_lender_name", "0.88e0", "2", "2"), "S-11": ("subject_property_rights", "0.90e0", "2", "null"),
}
RIGHT = {i: SUBJECT[i] for i in IDS} | {
    # the zip code of layout C stands 800 characters off at most, and Austin is what the letter says
    "S-5": when("coalesce(upper(trim(subject_neighborhood_name)), '') in ('', 'N/A', 'UNKNOWN')", "FAIL"),
    "S-7": when(none("subject_occupant_status"), "FAIL", "subject_occupant_status in ('Tenant', 'Vacant')", "VERIFY"),
}
CELLS = ", ".join(
    f"{{'rule_id': '{i}', 'status': {RIGHT[i]}, 'value': {v}, 'confidence': case when {v} is not null then {c} end, 'page': case when {v} is not null then {p} else {q} end}}" for i, (v, c, p, q) in EVIDENCE.items()
)


@query(f"{DOCS} select doc_id, unnest([{CELLS}], recursive := true) from d")
def document_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject rules of every document with value, confidence and page, from page texts alone."""
    out = reports.checked(pages(spark, sf_dir), YEAR, IDS, cross=False)
    return out.select("doc_id", "rule_id", "status", "value", "confidence", "page")


# every field of a report as text, and the page it is read from
FOUND = {
    "property_address": ("subject_address", 1), "city": ("subject_city", 1), "state": ("subject_state", 1), "zip_code": ("subject_zip_code", 1), "county": ("subject_county", "case when subject_county = 'Elsewhere' then 3 else 1 end"),
    "borrower_name": ("subject_borrower", 1), "owner_of_public_record": ("subject_owner_of_public_record", 1), "legal_description": ("subject_legal_description", 1), "assessors_parcel_number": ("subject_apn", 1), "tax_year": ("subject_tax_year", 1),
    "real_estate_taxes": ("case when subject_real_estate_taxes is not null then '4,000' end", 2), "neighborhood_name": ("subject_neighborhood_name", 2), "map_reference": ("subject_map_reference", 2), "census_tract": ("subject_census_tract", 2),
    "occupant_status": ("subject_occupant_status", 2), "special_assessments": ("cast(subject_special_assessments as integer)::varchar", 2), "hoa_dues": ("cast(subject_hoa_dues as integer)::varchar", 2), "property_rights": ("subject_property_rights", 2),
    "lender_name": ("subject_lender_name", 2), "lender_address": ("subject_lender_address", 2),
}


@query(f"""{DOCS} select * from (select doc_id, unnest([{", ".join(f"{{'field_name': '{n}', 'value': {v}, 'page': {p}}}" for n, (v, p) in FOUND.items())}], recursive := true) from d) where value is not null""")
def field_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject fields of every report, long form: the best of all pages, and its page."""
    return reports.page_fields(pages(spark, sf_dir)).where(F.col("kind") == "report").where(F.col("field_name").isin(list(FOUND))).select("doc_id", "field_name", "value", "page")


@query(f"""{DOCS} select doc_id, subject_address as property_address, subject_city as city, subject_state as state, subject_zip_code as zip_code,
 case when subject_address is not null then case when k % 3 = 1 then 0.55e0 when k % 3 = 2 then 0.75e0 else 0.85e0 end else 0e0 end as city_confidence from d""")
def report_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address, city, state and zip code of every first page, in three layouts."""
    first = pages(spark, sf_dir).where("kind = 'report' and page = 1")
    parts = first.select("doc_id", address_block(F.col("text"), fields.is_label).alias("a"))
    return parts.select("doc_id", *[F.col("a")[n]["value"].alias(n) for n in ("property_address", "city", "state", "zip_code")], F.coalesce(F.col("a")["city"]["confidence"], F.lit(0.0)).alias("city_confidence"))


STREAM = (
    "concat('Acme Sagecreek $0;; closing costs ', case when k % 6 = 0 then 'none' else cast(k % 90 + 10 as varchar(9)) end, ' 450 210 1 ', cast(k % 99 as varchar(9)), ' 22 ', cast(k % 80 as varchar(9)), ' 5 5 5 5', chr(10), 'North = Oak Rd South = Elm  Rd East = I-',"
    " cast(k as varchar(9)), ' West = River There are no apparent adverse factors here.', chr(10), 'Various types of financing, usually in 3-6 months. 6,000 sf ', cast(k as varchar(9)), ' sf Square N;Res; Form 1004UAD North = no')"
)


@query(f"""with d as (select c_custkey as doc_id, c_custkey as k from customer where c_custkey % 6 <> 0)
 select doc_id, unnest([{{'field_name': 'price_low', 'value': cast((k % 90 + 10) * 1000 as varchar)}}, {{'field_name': 'age_high', 'value': cast(k % 99 as varchar)}}, {{'field_name': 'land_use_total', 'value': cast(k % 80 + 20 as varchar)}},
 {{'field_name': 'neighborhood_boundaries', 'value': concat('North = Oak Rd; South = Elm Rd; East = I-', k, '; West = River')}}, {{'field_name': 'site_area', 'value': cast(k as varchar)}},
 {{'field_name': 'built_up', 'value': case when k % 80 + 10 >= 75 then 'Over 75%' end}}, {{'field_name': 'location', 'value': 'Suburban'}}], recursive := true) from d""")
def first_page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every flattened first page whose stream is whole."""
    streams = spread(table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", "c_custkey as k"), "doc_id").select("doc_id", F.expr(STREAM).alias("text"))
    read = streams.withColumn("s", page_stream(F.col("text")))  # a filter on it would work it out once more
    names = ["price_low", "age_high", "land_use_total", "neighborhood_boundaries", "site_area", "built_up", "location"]
    rows = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col("s")[n]["value"].alias("value")) for n in names])
    return read.select("doc_id", F.explode(F.when(F.col("s").isNotNull(), rows)).alias("f")).select("doc_id", "f.*")


LOT = "concat('Order 77 Lot ', cast(k as varchar(9)), ' Block B Sage A123 456 2', case when k % 3 = 0 then 'O' else '0' end, '23 4,100 Sage Creek 4567 1234.56 ', case when k % 4 = 0 then 'free' else cast(k % 500 as varchar(9)) end, ' 120 Form 1004UAD')"


@query("""select c_custkey as doc_id, concat('Lot ', c_custkey, ' Block B Sage') as legal_description, 'A123 456' as assessors_parcel_number, '2023' as tax_year, 'Sage Creek' as neighborhood_name,
 '1234.56' as census_tract, cast(c_custkey % 500 as varchar) as special_assessments, '120' as hoa_dues from customer where c_custkey % 4 <> 0""")
def aligned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page's facts without labels, aligned with the order of the fields; scanners' letters are read as digits."""
    streams = spread(table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", "c_custkey as k"), "doc_id").select("doc_id", F.expr(LOT).alias("text"))
    # rows without facts go in the explode, as a filter would align every text once more
    read = streams.withColumn("f", page_facts(F.col("text"))).select("doc_id", F.explode(F.when(F.col("f").isNotNull(), F.array("f"))).alias("f"))
    return read.select("doc_id", *[F.col("f")[n]["value"].alias(n) for n in ("legal_description", "assessors_parcel_number", "tax_year", "neighborhood_name", "census_tract", "special_assessments", "hoa_dues")])
