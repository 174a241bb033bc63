"""From page texts to rule results: fields of every page, the best of each, the declared document row, and evidence.

Pages come as rows (doc_id, kind, page, text), where kind is report, letter or agreement. Fields are read page by page, so
each knows its page; the best row of a field wins by source, then by confidence, then by page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.address_block import address_block
from docgauge.functions.value_stream import page_facts, page_stream
from docgauge.plans import fields, rules, spatial

KINDS = ("report", "letter", "agreement")

# fixed values: place in the document row, field, type
TARGETS = {
    "subject.address": ("property_address", "string"), "subject.city": ("city", "string"), "subject.state": ("state", "string"), "subject.zip_code": ("zip_code", "string"), "subject.county": ("county", "string"),
    "subject.borrower": ("borrower_name", "string"), "subject.co_borrower": ("co_borrower_name", "string"), "subject.owner_of_public_record": ("owner_of_public_record", "string"), "subject.legal_description": ("legal_description", "string"),
    "subject.apn": ("assessors_parcel_number", "string"), "subject.tax_year": ("tax_year", "string"), "subject.real_estate_taxes": ("real_estate_taxes", "double"), "subject.neighborhood_name": ("neighborhood_name", "string"),
    "subject.map_reference": ("map_reference", "string"), "subject.census_tract": ("census_tract", "string"), "subject.occupant_status": ("occupant_status", "string"), "subject.special_assessments": ("special_assessments", "double"),
    "subject.hoa_dues": ("hoa_dues", "double"), "subject.hoa_period": ("hoa_period", "string"), "subject.is_pud": ("is_pud_checked", "boolean"), "subject.lender_name": ("lender_name", "string"), "subject.lender_address": ("lender_address", "string"),
    "subject.property_rights": ("property_rights", "string"), "subject.offered_for_sale_12mo": ("offered_for_sale_12mo", "boolean"), "subject.data_source": ("data_source", "string"), "subject.mls_number": ("mls_number", "string"),
    "contract.assignment_type": ("assignment_type", "string"), "contract.did_analyze_contract": ("did_analyze_contract", "boolean"), "contract.sale_type": ("sale_type", "string"), "contract.contract_price": ("contract_price", "double"),
    "contract.contract_date": ("contract_date", "string"), "contract.owner_record_data_source": ("owner_record_data_source", "string"), "contract.financial_assistance": ("financial_assistance", "boolean"),
    "contract.financial_assistance_amount": ("financial_assistance_amount", "double"),
    "neighborhood.location": ("location", "string"), "neighborhood.built_up": ("built_up", "string"), "neighborhood.growth_rate": ("growth_rate", "string"), "neighborhood.property_values": ("property_values", "string"),
    "neighborhood.demand_supply": ("demand_supply", "string"), "neighborhood.marketing_time": ("marketing_time", "string"), "neighborhood.boundaries": ("neighborhood_boundaries", "string"),
    "neighborhood.description": ("neighborhood_description", "string"), "neighborhood.market_conditions": ("market_conditions_commentary", "string"),
    "neighborhood.price_low": ("price_low", "double"), "neighborhood.price_high": ("price_high", "double"), "neighborhood.predominant_price": ("predominant_price", "double"),
    "neighborhood.age_low": ("age_low", "int"), "neighborhood.age_high": ("age_high", "int"), "neighborhood.predominant_age": ("predominant_age", "int"),
    "neighborhood.land_use_one_unit": ("land_use_one_unit", "double"), "neighborhood.land_use_total": ("land_use_total", "double"),
    "site.dimensions": ("site_dimensions", "string"), "site.area": ("site_area", "double"), "site.area_unit": ("site_area_unit", "string"), "site.shape": ("site_shape", "string"), "site.view": ("site_view", "string"),
}
LETTER = {n: "string" for n in ("property_address", "city", "state", "zip_code", "county", "borrower_name", "lender_name", "lender_address", "assignment_type", "loan_type")}
AGREEMENT = {"contract_price": "double", "contract_date": "string", "seller_name": "string", "concessions_amount": "double"}

# fixed values: the field that a rule is mostly about
RULE_FIELD = {
    "S-1": "property_address", "S-2": "borrower_name", "S-3": "owner_of_public_record", "S-4": "legal_description", "S-5": "neighborhood_name", "S-6": "census_tract", "S-7": "occupant_status", "S-8": "special_assessments",
    "S-9": "hoa_dues", "S-10": "lender_name", "S-11": "property_rights", "S-12": "offered_for_sale_12mo", "C-2": "contract_price", "C-3": "owner_of_public_record", "C-4": "financial_assistance",
    "N-1": "neighborhood_description", "N-2": "market_conditions_commentary", "N-3": "price_low", "N-4": "land_use_total", "N-5": "neighborhood_boundaries", "N-6": "neighborhood_description", "N-7": "market_conditions_commentary",
    "ST-1": "site_dimensions", "ST-2": "site_area", "ST-3": "site_shape", "ST-4": "site_view", "COM-2": "market_conditions_commentary", "COM-7": "offered_for_sale_12mo",
}
# fixed values: what else a rule's page is known by, in order
RULE_TERMS = {
    "S-1": ["Property Address", "Subject", "City", "County"], "S-2": ["Borrower"], "S-3": ["Owner of Public Record"], "S-4": ["Legal Description", "Assessor", "Tax Year"], "S-5": ["Neighborhood Name", "Neighborhood"],
    "S-6": ["Map Reference", "Census Tract"], "S-7": ["Occupant", "Vacant", "Owner", "Tenant"], "S-8": ["Special Assessments"], "S-9": ["PUD", "HOA"], "S-10": ["Lender", "Client"],
    "S-11": ["Property Rights", "Fee Simple", "Leasehold"], "S-12": ["offered for sale", "Prior Sale", "Days on Market"], "C-1": ["Analyze Contract", "Contract"], "C-2": ["Contract Price", "Date of Contract", "Sale Price"],
    "C-3": ["Owner of Record", "Data Source"], "N-1": ["Neighborhood Characteristics", "Location", "Built-Up", "Growth"], "N-2": ["Housing Trends", "Property Values", "Demand", "Marketing Time"], "N-3": ["One-Unit Housing", "PRICE", "AGE"],
    "N-4": ["Present Land Use", "Land Use"], "N-5": ["Neighborhood Boundaries"], "N-6": ["Neighborhood Description"], "N-7": ["Market Conditions"], "ST-1": ["Dimensions", "Site Area", "Shape"], "ST-2": ["Site Area"], "ST-3": ["Shape"],
    "ST-4": ["View"], "ST-5": ["Zoning", "Legal"], "ST-6": ["Highest and Best Use"], "ST-7": ["Utilities", "Off-site Improvements"], "ST-8": ["FEMA", "Flood"], "ST-9": ["Utilities typical", "Public", "Private"],
    "I-1": ["General Description", "Effective Age"], "I-3": ["Exterior", "Roof Surface"], "I-5": ["Utilities", "inspection"], "I-7": ["Above Grade", "GLA", "Gross Living Area"], "SCA-1": ["Comparable", "currently offered", "sold"],
    "SCA-2": ["Comparable", "Sale Price"], "SCA-5": ["Data Source", "MLS", "DOM"], "PH-1": ["Subject Front", "Subject Rear", "Subject Street"], "PH-4": ["Attic", "Crawl", "FHA"], "SK-1": ["Sketch", "Floor Plan"],
    "FHA-2": ["FHA Case", "Case Number"], "FHA-3": ["FHA", "Intended Use", "Intended User"], "COM-2": ["Market Conditions", "1004MC"], "COM-3": ["Comparable Selection", "comparables were selected"],
    "COM-4": ["adjustment", "Sales Comparison"], "COM-5": ["Reconciliation"], "COM-6": ["Addendum", "Additional Comments", "Certification"], "COM-7": ["Prior Sale", "offered for sale", "Days on Market"],
}

CELL = "struct<value:string,confidence:double,method:string>"


def page_fields(pages: DataFrame) -> DataFrame:
    """One row per document, kind and field that any page has: value, confidence, method, page. Null texts have none.

    The page-1 stream comes before labels, labels before unlabelled facts. Each page's address and streams are worked
    out once, as columns, before its fields are listed.
    """
    text, page = F.col("text"), F.col("page")
    parts = lambda c, df: {n: F.col(c)[n] for n in df.schema[c].dataType.fieldNames()}
    out = None
    for kind in KINDS:
        own = pages.where(F.col("kind") == kind)
        if kind != "agreement":
            own = own.withColumn("address", address_block(text, fields.is_label))
        if kind == "report":
            own = own.withColumn("stream", page_stream(text)).withColumn("facts", page_facts(text)).withColumn("area", fields.neighborhood_parts(text))
            labelled = fields.subject(text, F.when(page <= 2, text)) | fields.neighborhood(text, F.col("area")) | fields.contract(text) | parts("address", own)
            sources = [(0, parts("stream", own)), (1, labelled), (2, parts("facts", own))]
        else:
            sources = [(1, parts("address", own)), (2, fields.letter(text))] if kind == "letter" else [(1, fields.agreement(text))]
        rows = [F.struct(F.lit(rank).alias("rank"), F.lit(n).alias("field_name"), c.cast(CELL).alias("cell")) for rank, named in sources for n, c in named.items()]
        # the test of the value stands in the array, as a filter behind the explode would evaluate every column once more
        some = own.select("doc_id", "kind", "page", F.explode(F.filter(F.array(*rows), lambda r: r["cell"]["value"].isNotNull())).alias("f"))
        out = some if out is None else out.unionByName(some)
    order = F.struct(F.col("f.rank"), (-F.col("f.cell.confidence")).alias("c"), F.col("page"))
    best = out.groupBy("doc_id", "kind", F.col("f.field_name").alias("field_name")).agg(F.min_by(F.struct("f.cell.*", "page"), order).alias("b"))
    return best.select("doc_id", "kind", "field_name", "b.*")


def typed(value: Column, kind: str) -> Column:
    """A field's text as the declared type: amounts lose signs and separators, what doesn't fit is null."""
    if kind == "string":
        return F.nullif(F.trim(value), F.lit(""))
    if kind == "boolean":
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    number = F.regexp_replace(value, "[,$]", "").try_cast("double")
    return number if kind == "double" else number.cast("int")


def with_sanity(cells: Column) -> Column:
    """The map of fields with the confidence of values that can't be right lowered and ``sanity_failed`` set."""
    tested = ("zip_code", "state", "property_address", "borrower_name", "market_value_opinion", "condition_rating", "tax_year")
    checked = fields.sanity({n: F.try_element_at(cells, F.lit(n)) for n in tested})
    row = lambda v, c, failed: F.struct(v["value"].alias("value"), c.alias("confidence"), v["method"].alias("method"), v["page"].alias("page"), failed.alias("sanity_failed"))

    def one(k: Column, v: Column) -> Column:
        out = None
        for n, c in checked.items():
            new = row(v, c["confidence"], c["sanity_failed"])
            out = F.when(k == n, new) if out is None else out.when(k == n, new)
        return out.otherwise(row(v, v["confidence"], F.lit(False)))

    return F.transform_values(cells, one)


def with_words(cells: DataFrame, words: DataFrame) -> DataFrame:
    """``page_fields`` rows with what the places of words give: ``spatial.near_labels`` for report fields that the text lacks,
    and marked boxes of the neighborhood grid, which also replace a choice that the text gives with less confidence.
    """
    marks = spatial.marked_choice(words, fields.CHOICES).withColumn("method", F.lit("spatial_anchor"))
    row = F.struct("value", "confidence", "method", "page").alias("b")
    unsure = F.col("field_name").isin(list(fields.CHOICES)) & (F.col("confidence") < 0.86)
    ranked = lambda df, kind, place: df.select("doc_id", kind.alias("kind"), "field_name", place.alias("place"), row)
    # one aggregation over all candidates, so that the text's fields are worked out once
    every = ranked(cells, F.col("kind"), F.when(unsure, 2).otherwise(0)).unionByName(ranked(marks, F.lit("report"), F.lit(1))).unionByName(ranked(spatial.near_labels(words), F.lit("report"), F.lit(3)))
    best = every.groupBy("doc_id", "kind", "field_name").agg(F.min_by("b", "place").alias("b"))
    return best.select("doc_id", "kind", "field_name", "b.*")


def assembled(pages: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The document row of ``rules.evaluate`` for each document with a page, from its fields alone.

    ``words`` are boxes of the reports' words (``spatial``), read for the fields that the text does not give.

    Columns: doc_id, raw_text, pages (texts), page_numbers, loan_type, assignment_type, the structs subject, contract,
    neighborhood, site, sales, letter and agreement, market_value_opinion, and fields, a map from each report field to
    value, confidence, method, page and sanity_failed. A document's fields are a bounded catalogue, its pages its own.
    """
    listed = page_fields(pages)
    cells = (listed if words is None else with_words(listed, words)).groupBy("doc_id").pivot("kind", list(KINDS)).agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("value", "confidence", "method", "page")))))
    own = pages.where("kind = 'report'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    docs = pages.select("doc_id").distinct().join(own, "doc_id", "left").join(cells, "doc_id", "left")
    docs = docs.withColumn("fields", with_sanity(F.col("report"))).withColumn("pages", F.col("p.text")).withColumn("raw_text", F.array_join("pages", "\n"))
    parts: dict[str, list[Column]] = {}
    for path, (name, kind) in TARGETS.items():
        at, field = path.split(".")
        value = typed(F.try_element_at("fields", F.lit(name))["value"], kind)
        parts.setdefault(at, []).append((F.coalesce(value, F.lit(False)) if path == "subject.is_pud" else value).alias(field))
    of = lambda kind, names: F.struct(*[typed(F.try_element_at(kind, F.lit(n))["value"], t).alias(n) for n, t in names.items()]).alias(kind)
    items = F.try_element_at("agreement", F.lit("personal_property_items"))["value"]
    listed = F.filter(F.transform(F.split(items, r"[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    agreement = F.struct(*[typed(F.try_element_at("agreement", F.lit(n))["value"], t).alias(n) for n, t in AGREEMENT.items()], listed.alias("personal_property_items")).alias("agreement")
    sold = F.filter(fields.comparables(F.col("raw_text")), lambda c: c["address"].isNotNull() | c["sale_price"].isNotNull())
    letter = lambda n: F.try_element_at("letter", F.lit(n))["value"]
    return docs.select(
        "doc_id", "raw_text", "pages", F.col("p.page").alias("page_numbers"), letter("loan_type").alias("loan_type"),
        F.coalesce(letter("assignment_type"), F.try_element_at("fields", F.lit("assignment_type"))["value"]).alias("assignment_type"),
        F.try_element_at("fields", F.lit("market_value_opinion"))["value"].alias("market_value_opinion"), "fields",
        *[F.struct(*cols).alias(at) for at, cols in parts.items()], F.struct(sold.alias("comparables"), F.size(sold).alias("count_sales")).alias("sales"), of("letter", LETTER), agreement,
    )


def first_page(terms: Column, texts: Column, numbers: Column) -> Column:
    """Number of the first page that holds the first of the terms, in their order, that any page holds; case does not count.

    Terms may differ from row to row; blank and null ones are passed over. ``texts`` are in lower case.
    """
    place = lambda t: F.array_position(F.transform(texts, lambda p: F.contains(p, F.lower(F.trim(t)))), True)
    usable = F.filter(terms, lambda t: F.coalesce(F.trim(t) != "", F.lit(False)))
    found = F.filter(F.transform(usable, place), lambda i: i > 0)
    return F.get(numbers, (F.get(found, F.lit(0)) - 1).cast("int"))


def rule_terms(rule_id: str, value: Column, message: Column) -> Column:
    """Terms of one rule's result in order: its value, what its message quotes (3 to 80 characters), the rule's own."""
    quoted = F.coalesce(F.regexp_extract_all(message, F.lit(r"'([^']{3,80})'"), 1), F.array().cast("array<string>"))
    return F.concat(F.array(value), quoted, F.array(*[F.lit(t) for t in RULE_TERMS.get(rule_id, [])]).cast("array<string>"))


def evidence_of(rule_id: str) -> Column:
    """struct(field, value, confidence, page) of a rule over ``assembled`` rows with ``low_pages``, their pages in lower case.

    The rule's field gives all of it; without its value the page is the first that names the rule's terms.
    """
    name = RULE_FIELD.get(rule_id)
    cell = F.try_element_at("fields", F.lit(name))
    value, page = (cell["value"], cell["page"]) if name else (F.lit(None).cast("string"), F.lit(None).cast("int"))
    guess = first_page(rule_terms(rule_id, value, F.lit(None).cast("string")), F.col("low_pages"), F.col("page_numbers")) if rule_id in RULE_TERMS or name else F.lit(None).cast("int")
    return F.struct(F.lit(name).alias("field"), value.alias("value"), (cell["confidence"] if name else F.lit(None).cast("double")).alias("confidence"), F.coalesce(page, guess).alias("page"))


def checked(pages: DataFrame, as_of_year: int, rule_ids: list[str] | None = None, cross: bool = True, store: Callable[[DataFrame], DataFrame] = lambda d: d, words: DataFrame | None = None) -> DataFrame:
    """Rule results of every document with the field, value, confidence and page each rests on, from page texts alone.

    ``store`` may write the assembled rows to a table and read them back, so that rules don't repeat the extraction.
    """
    docs = store(assembled(pages, words)).withColumn("low_pages", F.transform("pages", lambda p: F.lower(p)))
    return rules.evaluate(docs, as_of_year, rules=rule_ids, cross=cross, evidence=evidence_of)
