"""Readings of an older form service, kept for documents that were read with it: nine report fields, site fields, boxes.

Every function is a struct of Columns over one text. A null text has null fields and no marked box.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.text import let

# fixed values: the patterns of each field in order; case never counts, ^ and $ are at lines
REPORT = {
    "borrower_name": [r"Borrower[:\s]+([A-Z][a-z]+\s+[A-Z][a-z]+)", r"BORROWER[:\s]+([A-Z\s]+)", r"Borrower Name[:\s]+([^\n]+)"],
    "property_address": [r"Property Address[:\s]+([^\n]+)", r"Subject Property[:\s]+([^\n]+)", r"Address[:\s]+(\d+[^,\n]+(?:,\s*[^,\n]+){0,2})"],
    "appraised_value": [r"Appraised Value[:\s]*\$?([\d,]+)", r"Market Value[:\s]*\$?([\d,]+)", r"Opinion of Value[:\s]*\$?([\d,]+)"],
    "sale_price": [r"Sale Price[:\s]*\$?([\d,]+)", r"Contract Price[:\s]*\$?([\d,]+)", r"Purchase Price[:\s]*\$?([\d,]+)"],
    "effective_date": [r"Effective Date[:\s]+(\d{1,2}/\d{1,2}/\d{2,4})", r"Date of Value[:\s]+(\d{1,2}/\d{1,2}/\d{2,4})", r"As of[:\s]+(\d{1,2}/\d{1,2}/\d{2,4})"],
    "lender_name": [r"Lender[:\s]+([^\n]+)", r"Client[:\s]+([^\n]+)", r"Lender/Client[:\s]+([^\n]+)"],
    "appraiser_name": [r"Appraiser[:\s]+([^\n]+)", r"Signed[:\s]+([^\n]+)"],
    "appraiser_license": [r"License\s*#?\s*:?\s*([A-Z]{2}[-\s]?\d+)", r"State License[:\s]+([^\n]+)", r"Certification\s*#?\s*:?\s*([A-Z0-9-]+)"],
}
CITY_STATE_ZIP = r"([A-Za-z\s]+),?\s*([A-Z]{2})\s*(\d{5}(?:-\d{4})?)"
# fixed values: a box counts where its words are followed by yes or x within 20 characters of one line
BOXES = {
    "is_in_flood_zone": r"flood\s*(zone|area|hazard).{0,20}(yes|x|\[x\])",
    "is_for_sale": r"(for sale|currently listed|on market).{0,20}(yes|x|\[x\])",
    "has_pool_or_spa": r"(pool|spa).{0,20}(yes|x|\[x\])",
    "is_condo_or_pud": r"(condo|pud|planned unit).{0,20}(yes|x|\[x\])",
    "is_manufactured_home": r"(manufactured|mobile|modular).{0,20}(yes|x|\[x\])",
}


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_of(text: Column, patterns: list[str], flags: str = "(?im)") -> Column:
    """Group 1, stripped, of the first pattern that matches, even if that is empty; null if none does."""
    return F.coalesce(*[F.when(text.rlike(flags + p), stripped(F.regexp_extract(text, flags + p, 1))) for p in patterns])


def report_fields(text: Column) -> Column:
    """struct of the report's fields; the address also gives city, state and zip_code, amounts are doubles."""
    named = {n: first_of(text, p) for n, p in REPORT.items()}
    for n in ("appraised_value", "sale_price"):
        named[n] = F.replace(named[n], F.lit(","), F.lit("")).try_cast("double")
    part = lambda i: F.when(named["property_address"].rlike(CITY_STATE_ZIP), stripped(F.regexp_extract(named["property_address"], CITY_STATE_ZIP, i)))
    named |= {"city": part(1), "state": part(2), "zip_code": part(3)}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def site_fields(text: Column) -> Column:
    """struct of address, borrower, site, zoning, use, style, year and the number of comparables named.

    As in that service a zoning text that holds "Legal" is Legal unless it holds "Non-Conforming", and a use is only
    ever true or null.
    """
    behind = lambda c, n: F.when(n > 0, F.substring(c, n, F.lit(200)))
    zone = behind(text, F.instr(text, "Zoning Compliance"))
    use = behind(text, F.instr(F.lower(text), "highest and best use"))
    has = lambda c, w: F.contains(c, F.lit(w))
    zoning = F.when(has(zone, "Legal") & ~has(zone, "Non-Conforming"), "Legal").when(has(zone, "Legal Non-Conforming"), "Legal Non-Conforming").when(has(zone, "No Zoning"), "No Zoning").when(has(zone, "Illegal"), "Illegal")
    area = r"(?i)(?:Site Area|Area)\s*[:\.]?\s*([\d,]+(?:\.\d+)?)\s*(sf|sq\.?\s*ft|ac|acres)"
    number = F.replace(F.regexp_extract(text, area, 1), F.lit(","), F.lit("")).try_cast("double")
    size = F.coalesce(first_of(text, [r"Dimensions\s*[:\.]?\s*([\d\.]+\s*[xX]\s*[\d\.]+)"], ""), first_of(text, [r"Dimensions\s*[:\.]?\s*([^\n]{5,30})"], "(?i)"))
    return F.struct(
        F.replace(first_of(text, [r"(?:Property Address|Subject Property)[\s:.]+(.*?)(?:City|State|Zip|Borrower)"], "(?is)"), F.lit("\n"), F.lit(" ")).alias("property_address"),
        first_of(text, [r"Borrower[\s:.]+(.*?)(?:Owner|Occupant|Map Ref)"], "(?i)").alias("borrower_name"),
        size.alias("site_dimensions"),
        number.alias("site_area"),
        F.when(number.isNotNull(), F.lower(F.regexp_extract(text, area, 2))).alias("site_area_unit"),
        zoning.alias("zoning_compliance"),
        F.when(has(use, "Yes"), True).alias("highest_and_best_use"),
        first_of(text, [r"Design\s*\(Style\)\s*[:\.]?\s*([^\n\d]+)"], "(?i)").alias("design_style"),
        first_of(text, [r"Year Built[\s:.]+(\d{4})"], "(?i)").cast("int").alias("year_built"),
        F.coalesce(F.regexp_count(text, F.lit(r"Comparable Sale #\s*\d")), F.lit(0)).alias("comparable_count"),
    )


def boxes(text: Column) -> Column:
    """struct of five booleans, never null; a bare x counts, also inside a word, as in that service."""
    return F.struct(*[F.coalesce(F.lower(text).rlike(p), F.lit(False)).alias(n) for n, p in BOXES.items()])


# fixed values: states in the order in which their names are tried
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA",
    "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY", "DISTRICT OF COLUMBIA": "DC",
}


def normalized_address(text: Column) -> Column:
    """struct(full_address, street, unit, city, state, zip_code, zip_plus4, confidence) of a one-line address.

    The state is two capitals before the zip code or the end, else the first state whose name occurs; the city is the
    words before the state, the street what precedes the city. The zip code is the first five digits that stand alone, so
    a house number of five digits is taken for it, as in that service. Confidence is the share of street, city, state and zip
    code that was found. A null or empty text is an empty address of confidence 0.
    """
    null = lambda c: F.nullif(c, F.lit(""))
    got = lambda c, p, i: null(F.regexp_extract(c, p, i))
    at = lambda c, p: null(stripped(F.call_function("regexp_extract", c, p, F.lit(1))))
    ends = lambda c: null(F.regexp_replace(c, ",+$", ""))

    def parts(c: Column) -> Column:
        short = got(c, r"\b([A-Z]{2})\s*(?:\d{5}|$)", 1)
        by_name = F.coalesce(*[F.when(F.contains(F.upper(c), F.lit(n)), F.lit(s)) for n, s in STATES.items()])
        state = F.when(short.isNull(), by_name).when(short.isin(list(STATES.values())), short)
        return F.struct(c.alias("full"), state.alias("state"))

    def with_city(p: Column) -> Column:
        city = ends(at(p["full"], F.concat(F.lit(r"(?i)([A-Za-z\s]+?)\s*,?\s*"), p["state"])))
        return F.struct(p["full"].alias("full"), p["state"].alias("state"), city.alias("city"))

    def all_parts(p: Column) -> Column:
        c = p["full"]
        street = ends(at(c, F.concat(F.lit(r"(?i)^(.+?)\s*,?\s*\Q"), p["city"], F.lit(r"\E"))))
        code = got(c, r"\b(\d{5})(?:-(\d{4}))?\b", 1)
        found = [x.isNotNull().cast("int") for x in (street, p["city"], p["state"], code)]
        return F.struct(
            c.alias("full_address"), street.alias("street"), got(c, r"(?i)\b(?:apt|unit|suite|ste|#)\s*([A-Za-z0-9-]+)\b", 1).alias("unit"), p["city"].alias("city"), p["state"].alias("state"),
            code.alias("zip_code"), got(c, r"\b(\d{5})(?:-(\d{4}))?\b", 2).alias("zip_plus4"), (sum(found, F.lit(0)) / 4.0).alias("confidence"),
        )

    plain = F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), r"\s+", " ")
    return let(let(let(plain, parts), with_city), all_parts)


def parcel_number(text: Column) -> Column:
    """Single spaces, hyphens and points kept; null is empty."""
    return F.regexp_replace(stripped(F.coalesce(text, F.lit(""))), r"\s+", " ")


def area(text: Column) -> Column:
    """struct(value, unit): the first number, in acres where "ac" occurs, else in square feet; 0 sf without a number."""
    n = F.replace(F.regexp_extract(text, r"([\d,]+(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(F.coalesce(n, F.lit(0.0)).alias("value"), F.when(n.isNotNull() & F.contains(F.lower(text), F.lit("ac")), "ac").otherwise("sf").alias("unit"))


def square_feet_to_acres(c: Column) -> Column:
    return c / 43560.0
