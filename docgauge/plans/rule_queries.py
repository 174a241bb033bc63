"""Queries that run every rule and cross-field check over stand-in document rows, with SQL written from the rules' wording.

A document row is made from a customer's key: each field cycles through values that reach every status, and absent ones.
The field table is the queries' input in both engines; the statuses in SQL are stated on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.plans import rules
from docgauge.plans.catalog import query
from docgauge.sources.tables import spread, table

YEAR = 2024
# stand-in fields: expressions of k that both engines read alike
FIELDS = {
    "loan_type": "case k % 3 when 0 then 'FHA' when 1 then 'USDA Rural' else 'Conventional' end",
    "assignment_type": "case when k % 2 = 0 then 'Purchase' else 'Refinance Transaction' end",
    "vision_condition": "case k % 5 when 0 then 'C4' when 1 then 'c6' when 2 then 'C2' end",
    "form_type": "case k % 11 when 0 then '1073' when 1 then '1004' end",
    "market_value_opinion": "case k % 4 when 0 then '$350,000' when 1 then '350000' when 2 then '' end",
    "subject.address": "case k % 5 when 0 then null when 1 then ' ' else '12 Oak Street' end",
    "subject.city": "case k % 7 when 0 then null when 1 then 'Dallas' else 'Austin' end",
    "subject.state": "case k % 11 when 0 then 'OK' else 'TX' end",
    "subject.zip_code": "case k % 13 when 0 then '99999' when 1 then null else '78701-1234' end",
    "subject.county": "case k % 4 when 0 then null when 1 then 'Hays' else 'Travis' end",
    "subject.borrower": "case k % 6 when 0 then null when 1 then 'John Roe' else 'Jane Doe County of Travis' end",
    "subject.owner_of_public_record": "case k % 5 when 0 then null when 1 then 'John Roe' when 2 then 'Jane Doe County of Travis' else 'Jane Doe' end",
    "subject.legal_description": "case k % 7 when 0 then null else 'Lot 1' end",
    "subject.apn": "case k % 8 when 0 then ' ' else '1-2-3' end",
    "subject.tax_year": "case k % 5 when 0 then '2019' when 1 then 'x' else '2023' end",
    "subject.real_estate_taxes": "case k % 9 when 0 then null when 1 then 4000.25e0 else 4000e0 end",
    "subject.neighborhood_name": "case k % 4 when 0 then null when 1 then ' n/a ' when 2 then 'Unknown' else 'Sagecreek' end",
    "subject.map_reference": "case k % 5 when 0 then null else 'A1' end",
    "subject.census_tract": "case k % 6 when 0 then null when 1 then '12.3' when 2 then '1234' else '1234.56' end",
    "subject.occupant_status": "case k % 6 when 0 then null when 1 then 'Squatter' when 2 then 'tenant' when 3 then 'Vacant' else 'Owner' end",
    "subject.lease_dates": "case when k % 4 = 0 then '1/1/2024' end",
    "subject.rental_amount": "case when k % 8 = 0 then '900' end",
    "subject.utilities_on": "case when k % 5 = 0 then 'yes' end",
    "subject.special_assessments": "case k % 4 when 0 then null when 1 then 0e0 else 150e0 end",
    "subject.special_assessments_comment": "case k % 3 when 0 then 'street lights and paving' when 1 then 'short' end",
    "subject.hoa_dues": "case k % 4 when 0 then null when 1 then 0e0 else 120e0 end",
    "subject.is_pud": "case k % 3 when 0 then true when 1 then false end",
    "subject.hoa_period": "case k % 5 when 0 then 'per month' when 1 then ' ' end",
    "subject.lender_name": "case k % 4 when 0 then null when 1 then 'Other Bank' else 'First Bank' end",
    "subject.lender_address": "case k % 7 when 0 then '9 Else Rd' else '1 Main St' end",
    "subject.property_rights": "case k % 4 when 0 then null when 1 then 'rental' when 2 then 'fee simple' else 'Leasehold Interest' end",
    "subject.offered_for_sale_12mo": "case k % 3 when 0 then true when 1 then false end",
    "subject.mls_number": "case when k % 5 <> 0 then 'A77' end",
    "subject.days_on_market": "case when k % 7 <> 0 then '30' end",
    "subject.list_price": "case when k % 4 <> 0 then '300000' end",
    "subject.list_date": "case when k % 8 <> 0 then '1/1/2024' end",
    "subject.data_source": "case k % 6 when 0 then null when 1 then 'x' else 'MLS' end",
    "letter.property_address": "case k % 6 when 0 then null when 1 then 'PO Box 7777' when 2 then '12 OAK STREET Property County Travis' else '12 oak street' end",
    "letter.city": "case k % 5 when 0 then '' else 'AUSTIN' end",
    "letter.state": "'tx'",
    "letter.zip_code": "'78701'",
    "letter.county": "case k % 3 when 0 then null else 'travis' end",
    "letter.borrower_name": "case k % 7 when 0 then null else 'JANE DOE' end",
    "letter.lender_name": "case k % 3 when 0 then null else ' first bank ' end",
    "letter.lender_address": "case k % 5 when 0 then null else '1 MAIN ST' end",
    "contract.did_analyze_contract": "case k % 6 when 0 then null when 2 then false else true end",
    "contract.analysis_comment": "case k % 5 when 0 then 'short' else 'arms length sale, analysed in full' end",
    "contract.sale_type": "case when k % 7 <> 0 then 'Arms length' end",
    "contract.contract_price": "case k % 4 when 0 then null when 1 then 300e0 else 310e0 end",
    "contract.contract_date": "case k % 5 when 0 then null when 1 then '1/2/2024' else '2024-01-03' end",
    "contract.is_seller_owner": "case k % 6 when 0 then true when 2 then false end",
    "contract.owner_record_data_source": "case k % 5 when 0 then 'x' else 'County' end",
    "contract.owner_record_commentary": "case k % 7 when 0 then null else 'the seller bought it last year' end",
    "contract.financial_assistance": "case k % 6 when 0 then true when 2 then false end",
    "contract.financial_assistance_amount": "case k % 5 when 0 then null when 1 then 0e0 when 2 then 100e0 else 200e0 end",
    "contract.financial_assistance_description": "case k % 7 when 0 then 'abc' else 'closing costs' end",
    "contract.sales_concessions_comment": "case k % 5 when 0 then null when 1 then 'washer and dryer stay and contribute' when 2 then 'the washer has no value' else 'washer and dryer stay here' end",
    "contract.personal_property_contributes_to_value": "case when k % 3 = 0 then true end",
    "agreement.contract_price": "case k % 3 when 0 then null else 310e0 end",
    "agreement.contract_date": "case k % 3 when 0 then null else '01/03/2024' end",
    "agreement.concessions_amount": "case k % 4 when 0 then null when 1 then 0e0 else 200e0 end",
    "neighborhood.location": "case k % 3 when 0 then null else 'Urban' end",
    "neighborhood.built_up": "case k % 5 when 0 then ' ' else 'Over 75%' end",
    "neighborhood.growth_rate": "case k % 7 when 0 then null else 'Stable' end",
    "neighborhood.property_values": "case k % 4 when 0 then null when 1 then 'Increasing' when 2 then 'declining' else 'Stable' end",
    "neighborhood.demand_supply": "case k % 5 when 0 then null else 'In balance' end",
    "neighborhood.marketing_time": "case k % 7 when 0 then null else '3-6' end",
    "neighborhood.price_low": "case k % 5 when 0 then null when 1 then 900e0 else 100e0 end",
    "neighborhood.price_high": "case k % 7 when 0 then null else 320e0 end",
    "neighborhood.land_use_total": "case k % 4 when 0 then null when 1 then 90e0 when 2 then 100e0 else 101e0 end",
    "neighborhood.boundaries": "case k % 4 when 0 then null when 1 then 'North of A and south of B' else 'North A, south B, east C, west D' end",
    "neighborhood.description": "case k % 6 when 0 then null when 1 then 'a place' when 2 then 'There are no apparent adverse factors in this neighborhood' when 3 then 'this is a stable neighborhood, the market appears balanced' when 4 then 'Homes sell at $300,000 or 5% more because of the other vacant land' else 'a quiet area with trees and some small shops' end",
    "neighborhood.market_conditions": "case k % 7 when 0 then null when 1 then 'see 1004MC' when 2 then 'FHA and VA loan financing is at hand' when 3 then 'prices rose 5% to $300,000' when 4 then 'See 1004MC: up 5% to $300,000' when 5 then 'FHA and VA loans with inventory low' else 'nothing to be said' end",
    "site.dimensions": "case k % 4 when 0 then null when 1 then '9000' else '60 x 150' end",
    "site.area": "case k % 5 when 0 then null else '9,000 sf' end",
    "site.shape": "case k % 4 when 0 then null when 1 then 'Irregular' else 'Rectangular' end",
    "site.view": "case k % 3 when 0 then null else 'N;Res;' end",
    "site.zoning_compliance": "case k % 5 when 0 then null when 1 then 'Illegal' when 2 then 'Legal Nonconforming' when 3 then 'No Zoning' else 'Legal' end",
    "site.highest_best_use": "case k % 4 when 0 then null when 1 then false else true end",
    "site.electricity": "case k % 3 when 0 then true when 1 then false end",
    "site.sewer": "case k % 4 when 0 then true end",
    "site.fema_flood_hazard": "case k % 4 when 0 then true when 1 then false end",
    "site.flood_zone": "case k % 3 when 0 then 'X' end",
    "site.adverse_conditions": "case k % 4 when 0 then true when 1 then false end",
    "improvements.units_count": "case k % 3 when 0 then null else '1' end",
    "improvements.design_style": "case k % 4 when 0 then null else 'DT1' end",
    "improvements.year_built": "case k % 5 when 0 then null when 1 then 1990 else 2020 end",
    "improvements.effective_age": "case k % 6 when 0 then null when 1 then 9 else 3 end",
    "improvements.foundation_type": "case k % 3 when 0 then 'Slab' end",
    "improvements.exterior_walls": "case k % 3 when 0 then 'Brick' end",
    "improvements.roof_surface": "case k % 4 when 0 then 'Tile' end",
    "improvements.condition_rating": "case k % 6 when 0 then null when 1 then 'C1' when 2 then 'c5' when 3 then 'C2' when 4 then 'good' else ' ' end",
    "improvements.adverse_conditions": "case k % 4 when 0 then true when 1 then false end",
    "improvements.conforms_to_neighborhood": "case k % 4 when 0 then true when 1 then false end",
    "improvements.total_rooms": "case k % 5 when 0 then null else 7 end",
    "improvements.bedrooms": "case k % 7 when 0 then null else 3 end",
    "improvements.baths": "2e0",
    "improvements.gla": "case k % 4 when 0 then null else 1500e0 end",
    "sales.count_sales": "case k % 5 when 0 then null when 1 then 2 else 4 end",
    "sales.count_listings": "case k % 4 when 0 then null when 1 then 1 else 3 end",
    "sales.summary_commentary": "case k % 4 when 0 then null when 1 then 'too short' when 2 then 'the comparables were selected because they are close' else 'adjustments were made for size and age' end",
    "sales.reconciliation_commentary": "case k % 4 when 0 then null when 1 then 'short' when 2 then 'most weight is given to the first sale' else 'the approaches agree with each other' end",
}
COMPARABLE = {
    "address": "case (k + {j}) % 5 when 0 then null else '5 Elm St' end", "proximity": "case (k + {j}) % 6 when 0 then null when 1 then 'far away' else '0.5 miles NE' end", "data_source": "case (k + {j}) % 6 when 0 then ' ' when 1 then 'MLS' else 'MLS 7; DOM 30' end",
    "verification_source": "case (k + {j}) % 7 when 0 then null else 'Tax' end", "sale_date": "case (k + {j}) % 7 when 0 then null when 1 then '1/5/2022' else '1/5/2024' end", "location_rating": "case (k + {j}) % 6 when 0 then null when 1 then 'good' else 'N;Res;' end",
    "site_size": "case (k + {j}) % 7 when 0 then null else '9000 sf' end", "quality_rating": "case (k + {j}) % 6 when 0 then null when 1 then 'Q7' else 'q3' end", "actual_age": "case (k + {j}) % 7 when 0 then null else '30' end",
    "condition_rating": "case (k + {j}) % 6 when 0 then null when 1 then 'fair' else 'C3' end", "garage_carport": "case (k + {j}) % 7 when 0 then null else '2ga' end", "sale_price": "case (k + {j}) % 5 when 0 then null when 1 then 50e0 else 200e0 end",
    "room_count_total": "case (k + {j}) % 9 when 0 then null else 6 end", "room_count_bed": "3", "room_count_bath": "2e0", "gla": "case (k + {j}) % 8 when 0 then null else 1400e0 end",
}
# phrases of the stand-in report text; the i-th is in it where (k + i) % 5 < 2 or k % 97 = 96 (all of them)
PHRASES = [
    "Floors wood", "dishwasher", "energy efficient", "an addition", "security bars", "Concessions", "Fee Simple", "View", "DT1;Traditional", "Basement", "Functional Utility", "FWA/CAC", "Porch", "under construction", "Comparable Sale # 1",
    "reconciliation", "most reliable", "opinion of value: $350,000", "cost approach", "site value", "replacement cost new", "depreciation", "indicated value", "form 1007", "form 216", "dated sale", "1004MC", "Absorption Rate",
    "Total # of Comparable Sales", "There are 5 comparable sales", "There are 4 comparable properties currently offered", "Increasing", "Stable", "Declining", "USPAP", "state certified", "E&O", "UAD", "trainee", "Date of Signature", "03/04/2024",
    "Appraiser Name", "Company Name", "License", "SUPERVISORY APPRAISER Name X", "a.b@mail.example", "Subject Front", "Subject Rear", "Street Scene", "Kitchen", "Living Room", "Bedroom", "Bathroom", "outbuilding", "Subject Side", "attic", "Crawl", "deferred maintenance",
    "location map", "aerial view", "floor plan", "main level", "12 x 14", "garage", "GLA", "FHA Case Number 123-1234567", "intended use", "safety", "space heater", "remaining economic life 25", "septic", "rural development", "addendum", "typical for the area",
    "plat map", "FEMA map", "easement", "structural integrity", "property generally conform", "utilities were on", "utilities are typical Yes", "electricity", "Dimensions 60 x 150", "Area 9000 sf", "Shape square", "highest and best use Yes", "Other 5 %", "$0 closing cost",
    "Exterior Walls Brick", "Roof Surface Tile", "Condition is C3", "Unit One", "Design (Style) Ranch", "Year Built 1990", "Effective Age (Yrs) 9", "0.5 mi NE", "MLS 7 DOM 30", "Tax Records", "s01/24;c01/24", "N;Res;", "9000 sf", "Q3", "Actual Age 30", "Borrower Jane", "Client First",
    "condo", "because", "time adjustment of 5", "effective date 3/1/2024",
]
TEXT = "concat_ws(chr(10), 'report', " + ", ".join(f"case when (k + {i}) % 5 < 2 or k % 97 = 96 then '{p}' end" for i, p in enumerate(PHRASES)) + ")"
ITEMS = {"contract.personal_property_items": ["washer"], "agreement.personal_property_items": ["washer", "dryer;", "property is being sold as-is"]}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide document row a customer, for ``rules.evaluate``."""
    k = spread(table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", "c_custkey as k"), "doc_id")
    flat = k.select("doc_id", "k", F.expr(TEXT).alias("raw_text"), *[F.expr(e).alias(p.replace(".", "__")) for p, e in FIELDS.items()])
    comps = F.array(*[F.struct(*[F.expr(e.format(j=j)).alias(f) for f, e in COMPARABLE.items()]) for j in range(3)])
    parts: dict[str, list] = {}
    for path in FIELDS:
        if "." in path:
            parts.setdefault(path.split(".")[0], []).append(F.col(path.replace(".", "__")).alias(path.split(".")[1]))
    for path, items in ITEMS.items():
        given = F.slice(F.array(*[F.lit(x) for x in items]), F.lit(1), (F.col("k") % (len(items) + 1)).cast("int"))
        parts[path.split(".")[0]].append(given.alias(path.split(".")[1]))
    parts["sales"].append(F.slice(comps, F.lit(1), (F.col("k") % 4).cast("int")).alias("comparables"))
    return flat.select("doc_id", "raw_text", *[p for p in FIELDS if "." not in p], *[F.struct(*cols).alias(name) for name, cols in parts.items()])


def _input_sql() -> str:
    columns = [f"{e} as {p.replace('.', '_')}" for p, e in FIELDS.items()]
    comps = ", ".join("{" + ", ".join(f"'{f}': {e.format(j=j)}" for f, e in COMPARABLE.items()) + "}" for j in range(3))
    items = [f"list_slice([{', '.join(repr(x) for x in xs)}], 1, k % {len(xs) + 1}) as {p.replace('.', '_')}" for p, xs in ITEMS.items()]
    return f"with keys as (select c_custkey as k from customer), d as (select k as doc_id, {TEXT} as t, {', '.join(columns)}, {', '.join(items)}, list_slice([{comps}], 1, k % 4) as comps from keys)"


def has(pattern: str) -> str:
    return "regexp_matches(t, '(?i)" + pattern.replace("'", "''") + "')"


def none(x: str) -> str:
    return f"trim(coalesce(cast({x} as varchar), '')) = ''"


def comparables(field: str) -> str:
    """No comparables, or one without the field."""
    return f"(len(comps) = 0 or len(list_filter(comps, lambda c: {none('c.' + field)})) > 0)"


FHA, USDA, PURCHASE = "loan_type = 'FHA'", "loan_type = 'USDA Rural'", "assignment_type = 'Purchase'"
REFI = "assignment_type <> 'Purchase'"
V = "'VERIFY'"


def when(*arms: str, otherwise: str = "PASS") -> str:
    """case when condition then status, as condition and status in turn."""
    return "case " + " ".join(f"when {c} then '{s}'" for c, s in zip(arms[::2], arms[1::2], strict=True)) + f" else '{otherwise}' end"


def only(loans: str, status: str) -> str:
    return f"case when not ({loans}) then 'PASS' else {status} end"


def statuses(sql: dict[str, str]) -> str:
    cells = ", ".join(f"{{'rule_id': '{i}', 'status': {s}}}" for i, s in sql.items())
    return f"{_input_sql()} select doc_id, unnest([{cells}], recursive := true) from d"


def run(spark: SparkSession, sf_dir: str, ids: list[str]) -> DataFrame:
    return rules.evaluate(documents(spark, sf_dir), YEAR, rules=ids, cross=False).select("doc_id", "rule_id", "status")


def found(*patterns: str, yes: str = "PASS", no: str = "VERIFY") -> str:
    return when(" and ".join(map(has, patterns)), yes, otherwise=no)


SUBJECT = {
    "S-1": when(
        f"{none('subject_address')} or {none('letter_property_address')}", "VERIFY",
        "k_near and upper(coalesce(subject_city, '')) = 'AUSTIN' and letter_city <> '' and subject_state = 'TX' and left(coalesce(subject_zip_code, ''), 5) = '78701' and (letter_county is null or upper(coalesce(subject_county, '')) = 'TRAVIS')", "PASS", otherwise="FAIL",
    ).replace("k_near", "letter_property_address ilike '12 oak street%'"),
    "S-2": when(f"{none('subject_borrower')} or {none('letter_borrower_name')}", "VERIFY", "subject_borrower like 'John%'", "FAIL", f"{REFI} and subject_owner_of_public_record like 'John%'", "VERIFY"),
    "S-3": when(none("subject_owner_of_public_record"), "FAIL", f"{REFI} and not {none('subject_borrower')} and upper(subject_owner_of_public_record) <> upper(subject_borrower)", "VERIFY"),
    "S-4": when(f"subject_legal_description is null or {none('subject_apn')} or subject_tax_year is null or subject_real_estate_taxes is null", "VERIFY", "subject_tax_year <> '2023' or subject_real_estate_taxes = 4000.25", "FAIL"),
    "S-5": when("coalesce(upper(trim(subject_neighborhood_name)), '') in ('', 'N/A', 'UNKNOWN')", "FAIL"),
    "S-6": when("subject_map_reference is null or subject_census_tract is null", "VERIFY", "subject_census_tract not in ('1234', '1234.56')", "FAIL"),
    "S-7": when("coalesce(subject_occupant_status, '') in ('', 'Squatter')", "FAIL", "subject_occupant_status = 'tenant' and (subject_lease_dates is null or subject_rental_amount is null)", "VERIFY", "subject_occupant_status = 'Vacant' and subject_utilities_on is null", "VERIFY"),
    "S-8": when("subject_special_assessments is null", "VERIFY", "subject_special_assessments > 0 and length(coalesce(subject_special_assessments_comment, '')) < 10", "FAIL"),
    "S-9": when("subject_hoa_dues > 0 and not coalesce(subject_is_pud, false)", "FAIL", f"subject_hoa_dues > 0 and {none('subject_hoa_period')}", "VERIFY"),
    "S-10": when("letter_lender_name is null and letter_lender_address is null", "VERIFY", "letter_lender_name is not null and subject_lender_name is null", "VERIFY", "letter_lender_name is not null and subject_lender_name = 'Other Bank'", "FAIL", "letter_lender_address is not null and subject_lender_address <> '1 Main St'", "FAIL"),
    "S-11": when("subject_property_rights is null", "VERIFY", "subject_property_rights = 'rental'", "FAIL"),
    "S-12": when("subject_offered_for_sale_12mo is null or length(coalesce(subject_data_source, '')) < 2", "FAIL", "subject_offered_for_sale_12mo and (subject_mls_number is null or subject_days_on_market is null or subject_list_price is null or subject_list_date is null)", "VERIFY"),
    "I-5": when(f"subject_utilities_on is null and not {has(r'utilities?\s+(and appliances\s+)?(were\s+)?(on|off)')}", "FAIL"),
    "COM-7": when("subject_offered_for_sale_12mo is null", "VERIFY", "subject_offered_for_sale_12mo and (subject_days_on_market is null or subject_data_source is null)", "VERIFY"),
}

CONTRACT = {
    "C-1": when("contract_did_analyze_contract is null", "VERIFY", "not contract_did_analyze_contract", "FAIL", "length(contract_analysis_comment) < 20 or contract_sale_type is null", "VERIFY"),
    "C-2": when("contract_contract_price is null", "VERIFY", "agreement_contract_price is not null and contract_contract_price <> 310", "FAIL", "agreement_contract_date is not null and contract_contract_date = '1/2/2024'", "FAIL"),
    "C-3": when("contract_is_seller_owner is null", "VERIFY", "length(contract_owner_record_data_source) < 2", "FAIL", "not contract_is_seller_owner and contract_owner_record_commentary is null", "FAIL"),
    "C-4": when(
        "contract_financial_assistance is null", "VERIFY", "not contract_financial_assistance and coalesce(contract_financial_assistance_amount, 0) > 0", "FAIL", "not contract_financial_assistance", "PASS",
        f"{has(r'\$0\s*;?;?\s*(closing costs?|concessions?)')} or (coalesce(agreement_concessions_amount, 1) = 0 and coalesce(contract_financial_assistance_amount, 0) = 0)", "PASS", "coalesce(contract_financial_assistance_amount, 0) <= 0", "VERIFY",
        "length(contract_financial_assistance_description) < 5", "FAIL", "abs(contract_financial_assistance_amount - agreement_concessions_amount) > 0.01", "FAIL",
    ),
    "C-5": when(
        "len(agreement_personal_property_items) > 0 and contract_sales_concessions_comment is null", "FAIL",
        "len(agreement_personal_property_items) = 1 and not (contract_sales_concessions_comment like '%contribute%' or contract_sales_concessions_comment like '%value%')", "VERIFY",
        "len(agreement_personal_property_items) > 1 and contract_sales_concessions_comment not like '%dryer%contribute%'", "VERIFY",
        "len(contract_personal_property_items) > 0 and contract_personal_property_contributes_to_value is null", "VERIFY",
    ),
}
CONTRACT = {i: only(PURCHASE, s) for i, s in CONTRACT.items()}

AREA = {
    "N-1": when(f"neighborhood_location is null or {none('neighborhood_built_up')} or neighborhood_growth_rate is null", "VERIFY"),
    "N-2": when("neighborhood_property_values is null or neighborhood_demand_supply is null or neighborhood_marketing_time is null", "VERIFY"),
    "N-3": when("neighborhood_price_low is null or neighborhood_price_high is null", "VERIFY", "neighborhood_price_low > neighborhood_price_high", "FAIL", "len(list_filter(comps, lambda c: c.sale_price is not null)) = 0", "VERIFY"),
    "N-4": when("neighborhood_land_use_total is null", "VERIFY", "neighborhood_land_use_total = 90", "FAIL", f"{has(r'Other\s+5\s*%')} and coalesce(neighborhood_description, '') not like '%other vacant land%'", "VERIFY"),
    "N-5": when("neighborhood_boundaries is null", "VERIFY", "neighborhood_boundaries not ilike '%east%' or neighborhood_boundaries not ilike '%west%'", "FAIL"),
    "N-6": when("length(coalesce(neighborhood_description, '')) < 10", "VERIFY"),
    "N-7": when("neighborhood_market_conditions is null", "VERIFY", "neighborhood_market_conditions = 'see 1004MC'", "FAIL"),
    "COM-1": when("length(coalesce(neighborhood_description, '')) < 30", "VERIFY", "neighborhood_description like 'There are no apparent%' or neighborhood_description like 'this is a stable%'", "FAIL"),
    "COM-2": when("neighborhood_market_conditions = 'prices rose 5% to $300,000'", "PASS", otherwise="FAIL"),
}

SITE = {
    "ST-1": when(f"site_dimensions is null and not {has(r'Dimensions\s+[0-9]')}", "VERIFY", f"site_shape = 'Irregular' and not {has('plat|survey')}", "VERIFY", "site_dimensions = '9000' and site_area is not null", "VERIFY"),
    "ST-2": when(f"site_area is null and not {has(r'\bArea\s+[\d,.]+\s*(sf|sq\.?\s*ft|ac)')}", "VERIFY"),
    "ST-3": when(f"site_shape is null and not {has(r'\bShape\s+[A-Za-z]+')}", "VERIFY"),
    "ST-4": when(f"site_view is null and not {has(r'\bView\s+[A-Z];[A-Za-z]+')}", "VERIFY"),
    "ST-5": when("site_zoning_compliance = 'Illegal'", "FAIL", "coalesce(site_zoning_compliance, '') <> 'Legal'", "VERIFY"),
    "ST-6": when(f"site_highest_best_use is null and not {has('highest and best use.{0,200}?yes')}", "VERIFY", "site_highest_best_use = false", "FAIL"),
    "ST-7": when(f"coalesce(site_electricity, false) or coalesce(site_sewer, false) or {has(r'\b(electricity|gas|water|sanitary sewer)\b')}", "PASS", otherwise="VERIFY"),
    "ST-8": when("coalesce(site_fema_flood_hazard, false)", "VERIFY", f"site_flood_zone is null and not {has('FEMA|FLOOD')}", "VERIFY"),
    "ST-9": found(r"(?s)utilities.{0,80}typical.{0,80}\bYes\b"),
    "ST-10": when(f"coalesce(site_adverse_conditions, false) or not {has('easement|encroachment|environmental condition|adverse site')}", "VERIFY"),
    "M-3": when(f"(site_dimensions is not null and site_shape = 'Rectangular') or {has('plat map|survey|site plan')}", "PASS", otherwise="VERIFY"),
    "M-4": when(has("flood map|FEMA map|flood hazard"), "PASS", "coalesce(site_fema_flood_hazard, false)", "FAIL", otherwise="VERIFY"),
}

BUILDING = {
    "I-1": when(f"(improvements_units_count is null and not {has(r'\bUnits?\b.*(One|1)')}) or (improvements_design_style is null and not {has(r'Design\s*\(Style\)\s+[A-Za-z]')}) or (improvements_year_built is null and not {has(r'Year\s+Built\s+\d{4}')}) or (improvements_effective_age is null and not {has(r'Effective\s+Age\s*\(Yrs\)?\s*\d+')})", "VERIFY"),
    "I-2": when(f"improvements_foundation_type is null and not {has(r'Concrete\s+Slab|Crawl\s+Space|Basement|Foundation')}", "VERIFY"),
    "I-3": when(f"(improvements_exterior_walls is null and not {has(r'Exterior\s+Walls?\s+[A-Za-z]')}) or (improvements_roof_surface is null and not {has(r'Roof\s+Surface\s+[A-Za-z]')})", "VERIFY"),
    "I-7": when("improvements_total_rooms is null or improvements_bedrooms is null or improvements_gla is null", "VERIFY"),
    "I-9": when(f"improvements_condition_rating in ('C1', 'c5', 'C2') or ({none('improvements_condition_rating')} and {has(r'(?s)Condition.*?\bC[1-6]\b')})", "PASS", otherwise="FAIL"),
    "I-10": when(f"coalesce(improvements_adverse_conditions, false) or not {has('(?s)adverse conditions.*(Yes|No)|livability|soundness|structural integrity')}", "VERIFY"),
    "I-11": when("improvements_conforms_to_neighborhood = false", "VERIFY", f"improvements_conforms_to_neighborhood is null and not {has('(?s)conform to the neighborhood.*(Yes|No)|property generally conform')}", "VERIFY"),
}

SALES_TEXT, LISTINGS_TEXT = has(r"There\s+are\s+5\s+comparable\s+sales"), has(r"There\s+are\s+4\s+comparable\s+properties\s+currently\s+offered")


def each(field: str, evidence: str, then: str, misfit: str | None = None, status: str = "FAIL") -> str:
    """A comparable lacks the field: the text stands in; one doesn't fit: ``misfit`` is its test."""
    arms = [f"{comparables(field)} and {has(evidence)}", then, comparables(field), "VERIFY"]
    return when(*arms, *([f"len(list_filter(comps, lambda c: {misfit})) > 0", status] if misfit else []))


SALES = {
    "SCA-1": when(f"(sales_count_sales is null and not {SALES_TEXT}) or (sales_count_listings is null and not {LISTINGS_TEXT})", "VERIFY"),
    "SCA-2": when(f"sales_count_sales is null and not {SALES_TEXT}", "VERIFY", "sales_count_sales = 2", "FAIL", f"sales_count_listings is null and not {LISTINGS_TEXT}", "VERIFY", "sales_count_listings = 1", "FAIL"),
    "SCA-3": when(f"{none('subject_address')} or {comparables('address')}", "VERIFY"),
    "SCA-4": each("proximity", r"\b\d+(\.\d+)?\s*(miles?|mi)\s*(N|S|E|W|NE|NW|SE|SW)\b", "PASS", "c.proximity = 'far away'"),
    "SCA-5": each("data_source", r"MLS#?\s*\d+.*DOM\s*\d+|DOM\s*\d+", "PASS", "c.data_source = 'MLS'", "VERIFY"),
    "SCA-6": each("verification_source", r"Verification\s+Source\(s\)|Tax\s+Records?|Previous\s+Appraisal|Tax\s+Cards", "PASS"),
    "SCA-8": each("sale_date", r"\b(s|c)\d{2}/\d{2};c\d{2}/\d{2}|Date\s+of\s+Sale/Time", "VERIFY"),
    "SCA-9": each("location_rating", r"\bN;Res;|\bB;|\bA;|\bAdj", "PASS", "c.location_rating = 'good'"),
    "SCA-11": each("site_size", r"\b\d[\d,]*\s*sf\b|\b\d+(\.\d+)?\s*ac\b", "PASS"),
    "SCA-14": each("quality_rating", "Q3", "PASS", "c.quality_rating = 'Q7'"),
    "SCA-15": each("actual_age", r"Actual\s+Age\s+\d+|\bAge\s+\d+", "PASS"),
    "SCA-16": each("condition_rating", "C3", "PASS", "c.condition_rating = 'fair'"),
    "SCA-17": when("len(list_filter(comps, lambda c: c.room_count_total is null or c.gla is null)) > 0", "VERIFY"),
    "SCA-21": each("garage_carport", "Garage/Carport|2ga2dw|garage", "PASS"),
    "ADD-2": when("sales_summary_commentary like '%selected because%'", "PASS", f"sales_summary_commentary is null and {has('selected because|selected based on|most similar|proximity|bracket')}", "PASS", otherwise="VERIFY"),
    "COM-3": when("sales_count_sales = 2", "FAIL", "coalesce(sales_summary_commentary, '') not like '%selected because%'", "VERIFY"),
    "COM-4": when("coalesce(sales_summary_commentary, '') like '%adjustments%'", "PASS", otherwise="VERIFY"),
    "COM-5": when("coalesce(sales_reconciliation_commentary, '') like '%most weight%'", "PASS", otherwise="VERIFY"),
}

ADDENDA = "substr(t, least(case when strpos(lower(t), 'addendum') > 0 then strpos(lower(t), 'addendum') else 1000000 end, case when strpos(lower(t), 'state certification') > 0 then strpos(lower(t), 'certification') else 1000000 end))"
PART = f"case when {has('addendum')} then {ADDENDA} else right(t, 5000) end"
REPORT = {
    "I-4": found(r"\b(Floors?|Walls?|Trim/Finish|Bath\s+Floor|Bath\s+Wainscot|Interior)\b"), "I-6": only(FHA, found("dishwasher")), "I-8": found("energy efficient"), "I-12": V, "I-13": found("security bars?", yes="VERIFY", no="PASS"), "SCA-7": V,
    "SCA-10": found(r"Fee\s+Simple"), "SCA-12": V, "SCA-13": found(r"DT1;Traditional|Design\s*\(Style\)"), "SCA-18": V, "SCA-19": found(r"Functional\s+Utility|Average"), "SCA-20": found("FWA/CAC"), "SCA-22": found("Porch"),
    "SCA-23": V, "SCA-24": V, "SCA-25": found("under construction", yes="VERIFY", no="PASS"), "SCA-26": V, "SCA-27": only(FHA, V), "R-1": found("reconciliation", "weight|most reliable"), "R-2": found(r"opinion of value\s*[:$]?\s*\$?\d[\d,]+"),
    "CA-1": only(USDA, when(f"{has('rural development')} and not {has('cost approach')}", "FAIL", otherwise="VERIFY")), "CA-2": only(USDA, found("cost approach", "site value", "cost new", "depreciation", "indicated value")), "IA-1": V, "IA-2": found(r"form\s*216"),
    "ADD-1": when(f"not {has('addendum|comments?|sales comparison|reconciliation')}", "VERIFY", has("typical for the area"), "VERIFY"), "ADD-3": V, "ADD-4": only(f"{FHA} or {USDA}", found("1004MC")), "ADD-5": only(f"{FHA} or {USDA}", V), "ADD-6": only(f"{FHA} or {USDA}", V), "ADD-7": V,
    "ADD-8": when(f"coalesce(form_type, '') = '1073' or {has('condo|co-?op')}", "VERIFY"), "ADD-9": V, "DOC-1": V, "DOC-2": V, "DOC-3": found(r"\bUAD\b"), "DOC-4": found("trainee|supervisory appraiser", yes="VERIFY", no="PASS"), "SIG-1": found("Date of Signature", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"),
    "SIG-2": V, "SIG-3": found("SUPERVISORY APPRAISER Name X", yes="VERIFY", no="PASS"), "SIG-4": found("a.b@mail[.]example"), "PH-1": found("Subject Front", "Subject Rear", "Street Scene"), "PH-2": found("Kitchen", "Living Room", "Bedroom", "Bathroom"), "PH-3": V,
    "PH-4": only(FHA, found("Subject Side", "attic", "crawl")), "PH-5": V, "PH-6": found("deferred maintenance", yes="VERIFY", no="PASS"), "M-1": found("location map"), "M-2": found("aerial view"), "SK-1": found("floor plan"), "SK-2": V, "SK-3": found(r"\d+\s*x\s*\d+"), "SK-4": V, "SK-5": V,
    "FHA-1": only(FHA, V), "FHA-2": only(FHA, found(r"FHA Case Number.*\d{3}-\d{7}", no="FAIL")), "FHA-3": only(FHA, V), "FHA-4": only(FHA, V), "FHA-5": only(FHA, V), "FHA-6": only(FHA, V), "FHA-7": only(FHA, found("space heater", yes="VERIFY", no="PASS")),
    "FHA-8": only(FHA, found("security bars?", yes="VERIFY", no="PASS")), "FHA-9": only(FHA, V), "FHA-10": only(FHA, found(r"remaining economic life.*\d")), "FHA-11": only(FHA, V), "FHA-12": only(FHA, found("well|septic", yes="VERIFY", no="PASS")), "FHA-13": only(FHA, V), "FHA-14": only(FHA, V),
    "USDA-1": only(USDA, found("cost approach", no="FAIL")), "MF-1": V, "MF-2": found(r"form\s*216"),
    "COM-6": when(
        f"not {none('subject_address')} and not contains(regexp_replace(lower({PART}), '[^a-z0-9]+', '', 'g'), '12oakstreet') and regexp_matches({PART}, '\\b\\d{{2,6}}\\s+[A-Za-z0-9 .''-]{{3,80}}\\b')", "VERIFY",
        f"subject_borrower is not null and regexp_matches({PART}, '(?i)\\bborrower\\b')", "VERIFY", f"subject_lender_name is not null and regexp_matches({PART}, '(?i)\\b(lender|client)\\b')", "VERIFY",
        f"coalesce(market_value_opinion, '') <> '' and len(regexp_extract_all({PART}, '\\$\\s*\\d[\\d,]{{3,}}')) > 0 and not contains({PART}, '350,000')", "VERIFY",
    ),
}

FAMILIES = {"subject": SUBJECT, "contract": CONTRACT, "neighborhood": AREA, "site": SITE, "improvements": BUILDING, "sales": SALES, "report": REPORT}


@query(statuses(SUBJECT))
def rules_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, list(SUBJECT))


@query(statuses(CONTRACT))
def rules_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, list(CONTRACT))


@query(statuses(AREA))
def rules_neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, list(AREA))


@query(statuses(SITE))
def rules_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, list(SITE))


@query(statuses(BUILDING))
def rules_improvements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, list(BUILDING))


@query(statuses(SALES))
def rules_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, list(SALES))


@query(statuses(REPORT))
def rules_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, list(REPORT))


RATING = "upper(improvements_condition_rating)"
CROSS = {
    "XF-1": f"case when neighborhood_property_values in ('Increasing', 'declining') and not {has(r'(time|date)[^0-9\n]{0,40}[1-9]')} then 'FAIL' end",
    "XF-2": "case when len(list_filter(comps, lambda c: c.sale_price < neighborhood_price_low or c.sale_price > neighborhood_price_high)) > 0 then 'VERIFY' end",
    "XF-3": f"case when ({RATING} = 'C1' and improvements_effective_age > 5) or ({RATING} = 'C5' and improvements_effective_age < 0.5 * ({YEAR} - improvements_year_built)) then 'VERIFY' end",
    "XF-VIS-1": f"case when {RATING} in ('C1', 'C2') and upper(vision_condition) in ('C4', 'C6') then 'VERIFY' end",
    "XF-5": "case when subject_hoa_dues > 0 and not coalesce(subject_is_pud, false) then 'FAIL' when subject_hoa_dues = 0 and subject_is_pud then 'VERIFY' end",
    "XF-6": f"case when {REFI} then 'FAIL' end",
    "XF-FHA-1": f"case when ({FHA} or contains(t, 'FHA')) and not {has(r'\b\d{3}-\d{7}\b')} then 'FAIL' end",
    "XF-FHA-2": f"case when ({FHA} or contains(t, 'FHA')) and {has('effective date 3/1/2024')} and len(list_filter(comps, lambda c: c.sale_date = '1/5/2022')) > 0 then 'FAIL' end",
    "XF-FHA-3": f"case when ({FHA} or contains(t, 'FHA')) and {has('remaining economic life 25')} and not {has('because|due to|explain')} then 'FAIL' end",
}


@query(f"select * from ({statuses(CROSS)}) where status is not null")
def rules_cross_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cross-field checks but XF-4, whose ratio SQL lacks."""
    out = rules.evaluate(documents(spark, sf_dir), YEAR, rules=[]).where("rule_id <> 'XF-4'")
    return out.select("doc_id", "rule_id", "status")


# all rules over bare texts: every field is absent, so that a status rests on the text or on what a missing field means
N_SALES, N_LISTINGS = (rf"try_cast(regexp_extract(t, '(?i)There\s+are\s+(\d+)\s+comparable\s+{x}', 1) as integer)" for x in ("sales", r"properties\s+currently\s+offered"))
BEST_USE = r"lower(regexp_extract(t, '(?i)highest and best use.{0,200}?\b(Yes|No)\b', 1))"
EVERY = {i: f for family in FAMILIES.values() for i, f in family.items()} | CROSS
EVERY |= {  # where the stand-in documents need less of a rule than texts at large, or always have a contract
    "SIG-4": found(r"[A-Z0-9._%+-]+@[A-Z0-9.-]+[.][A-Z]{2,}"), "SCA-14": when(r"regexp_matches(t, '\bQ[1-6]\b')", "PASS", otherwise="VERIFY"), "SCA-16": when(r"regexp_matches(t, '\bC[1-6]\b')", "PASS", otherwise="VERIFY"),
    "SCA-22": found("CFP|CBP|Patio|Porch|Deck"), "XF-6": "null::varchar",
    "I-5": found(r"utilities?\s+(and appliances\s+)?(were\s+)?(on|off)|all utilities.*were on", no="FAIL"), "I-8": found(r"\bAdditional\s+Features\b|\bStandard insulation\b|\benergy efficient\b|\bnone\b"),
    "I-13": found("security bars?|window bars?|release latch", yes="VERIFY", no="PASS"), "SCA-20": found(r"Heating/Cooling|FWA/CAC|Central\s+Air"), "SCA-25": found("(new|proposed|under) construction", yes="VERIFY", no="PASS"),
    "ST-1": when(r"trim(regexp_extract(t, '(?i)Dimensions\s+([0-9.'' xX]+)', 1)) = ''", "VERIFY"), "ST-6": when(f"{BEST_USE} = 'yes'", "PASS", f"{BEST_USE} = 'no'", "FAIL", otherwise="VERIFY"),
    "SCA-1": when(f"{N_SALES} is null or {N_LISTINGS} is null", "VERIFY"), "SCA-2": when(f"{N_SALES} is null", "VERIFY", f"{N_SALES} < 3", "FAIL", f"{N_LISTINGS} is null", "VERIFY", f"{N_LISTINGS} < 2", "FAIL"), "COM-3": when(f"{N_SALES} < 3", "FAIL", otherwise="VERIFY"),
    "R-1": found("reconciliation|indicated value by sales comparison|sales comparison approach", "weight|most reliable|best indicator|given.*consideration|supportive and reasonable conclusion|opinion of market value"),
    "R-2": found(r"(final opinion of value|appraised value|opinion of value|Indicated Value by Sales Comparison Approach|APPRAISED VALUE OF SUBJECT PROPERTY)\s*[:$]?\s*\$?\d[\d,]+"),
    "IA-2": found(r"form\s*216|operating income statement"), "MF-2": found(r"form\s*216|operating income statement"),
    "ADD-1": when(f"not {has('addendum|comments?|sales comparison|reconciliation')}", "VERIFY", has("typical for the area|no adverse conditions were noted|see attached addendum"), "VERIFY"), "DOC-3": found(r"\bUAD\b|Uniform Appraisal Dataset"),
    "SIG-1": found(r"(?s)signature of appraiser|appraiser signature|APPRAISER\s+.*Signature|Date of Signature|Date Signed|signed", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"), "SIG-3": found(r"(?s)SUPERVISORY APPRAISER.*(Name|Signature).{0,80}\S", yes="VERIFY", no="PASS"),
    "PH-1": found(r"Subject\s+Front|Front\s+Exterior", r"Subject\s+Rear|Rear\s+Exterior", r"Subject\s+Street|Street\s+Scene"),
    "PH-2": found(r"Subject\s+Kitchen|\bKitchen\b", r"Subject\s+Living\s+Room|\bLiving\s+Room\b", r"Subject\s+Bedroom|\bBedroom\b", r"Subject\s+Bath(room)?|\bBathroom\b"),
    "PH-6": found("obsolescence|external factor|deferred maintenance|damage", yes="VERIFY", no="PASS"), "M-1": found("location map|subject.*comparables|comparable.*map"), "M-2": found("aerial (map|view)|satellite"), "SK-1": found("floor plan|sketch|ANSI standards|measured per ANSI"),
    "SK-3": found(r"""\d+(\.\d+)?\s*x\s*\d+(\.\d+)?|\d+'\s*-\s*\d+"|measured per ANSI|ANSI standards"""), "COM-6": when("trim(t) = ''", "VERIFY"),
    "XF-FHA-3": rf"case when contains(t, 'FHA') and try_cast(regexp_extract(t, '(?i)remaining economic life\D{{0,40}}(\d{{1,3}})', 1) as integer) < 30 and not {has('because|due to|explain')} then 'FAIL' end",
}
BARE = f"""{_input_sql()}, none as (select * exclude (doc_id, t, loan_type, assignment_type, comps) from d where false),
 bare as (select documents.doc_id, coalesce(text, '') as t, '' as loan_type, '' as assignment_type, list_slice((select any_value(comps) from d), 1, 0) as comps, none.* from documents left join none on false)"""


@query(f"""{BARE} select rule_id, status, count(*) as n from (select unnest([{", ".join(f"{{'rule_id': '{i}', 'status': {s}}}" for i, s in EVERY.items())}], recursive := true) from bare) where status is not null group by 1, 2""")
def rule_engine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules and cross-field checks over all documents' texts: rows per rule and status."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text")), "doc_id")
    return rules.evaluate(docs, YEAR).groupBy("rule_id", "status").agg(F.count("*").alias("n"))
