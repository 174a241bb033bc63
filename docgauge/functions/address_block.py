"""The address of a report's first page in its three layouts, by anchoring on the zip code and peeling leftwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.text import digits_for_letters, let

#: Characters behind the label in which a lone zip code, state and city are looked for.
ZONE = 800

# fixed values: the label with its value, by layout: all parts on one line, the value on the next line, the value behind it
LAYOUTS = [
    r"(?i)Property Address\s*[=:\s]+(.*?(?:City|State|Zip).*)",
    r"(?i)Property Address\s*[=:\s]*\n+\s*(\d[^\n]{5,80})",
    r"(?i)Property Address\s*[=:\s]+(.+)",
]
ZIP = r"\b(\d{5}(?:-\d{4})?)\b"
FORM_WORDS = r"(?i)\b(?:zip|code|state|county|property|address)\b"


def part(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, trimmed; null without one."""
    return F.nullif(F.trim(F.regexp_extract(c, pattern, group)), F.lit(""))


def before(c: Column, pattern: str) -> Column:
    """The trimmed text in front of the first match; all of it without one."""
    return F.trim(F.split(c, pattern, 2).getItem(0))


def cell(value: Column, confidence: float, method: str = "spatial_anchor") -> Column:
    """struct(value, confidence, method); a missing value has confidence 0, one that scanners spoilt 0.05 less."""
    none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit("not_found").alias("method"))

    def row(v: Column) -> Column:
        sure = F.when(digits_for_letters(v) != v, round(confidence - 0.05, 2)).otherwise(confidence)
        return F.when(v.isNotNull(), F.struct(digits_for_letters(v).alias("value"), sure.cast("double").alias("confidence"), F.lit(method).alias("method"))).otherwise(none)

    return let(value, row)


def address_block(text: Column, is_label: Callable[[Column], Column] = lambda c: F.lit(False)) -> Column:
    """struct of property_address, city, state and zip_code, each struct(value, confidence, method).

    The line is the first layout's that matches. A zip code in it is the anchor: two capitals before it (else behind
    "State") are the state, the text behind "City" is the city, the rest the street; without "City" the last capitalised
    word is taken for the city, at 0.55. A line without a zip code is the street, and the other parts are looked for
    within ``ZONE`` characters behind the label. ``is_label`` says of a street whether it is a label of the form. A null
    text has no parts.
    """
    shown = lambda c: F.when(~F.coalesce(is_label(c), F.lit(False)), c)

    def peeled(line: Column) -> Column:
        """Parts of a line that holds a zip code."""
        shape, named, city = r"\b([A-Z]{2})\s*$", r"(?i:State)[:\s]+((?i:[A-Z]{2}))", r"(?i)City[:\s]+"
        ends = r"(?i)City[:\s]+(.*?)(?:\s+(?:State|[A-Z]{2}\s*$)|$)"

        def split(state: Column, rest: Column) -> Column:
            keyword = rest.rlike(city)
            marked = F.regexp_replace(part(rest, ends), r"(?i)\s+State\s*$", "")
            last = part(rest, r"\s(\p{Lu}\S*)$")
            street = F.when(keyword, before(rest, city)).when(last.isNotNull(), F.trim(F.regexp_replace(rest, r"\s\S+$", ""))).otherwise(rest)
            town = F.when(keyword, cell(F.when(~marked.rlike(FORM_WORDS), F.nullif(marked, F.lit(""))), 0.85)).otherwise(cell(last, 0.55, "regex_fallback"))
            return F.struct(cell(shown(F.nullif(street, F.lit(""))), 0.85).alias("property_address"), town.alias("city"), cell(state, 0.90).alias("state"), cell(part(line, ZIP), 0.92).alias("zip_code"))

        def by_state(head: Column) -> Column:
            state = F.upper(F.coalesce(part(head, shape), part(head, named)))
            rest = F.when(part(head, shape).isNotNull(), before(head, shape)).when(state.isNotNull(), before(head, named)).otherwise(head)
            return let(F.struct(state.alias("state"), rest.alias("rest")), lambda x: split(x["state"], x["rest"]))

        return let(before(line, ZIP), by_state)

    def scattered(line: Column, zone: Column) -> Column:
        """Parts of a line without a zip code."""
        town = part(zone, r"(?i)City[:\s]*([A-Za-z][A-Za-z\s]{2,30}?)(?:\n|County|State|Zip|$)")
        lone = F.coalesce(part(zone, r"(?i)Zip\s*(?:Code)?[:\s]*(\d{5}(?:-\d{4})?)"), part(zone, ZIP))
        cells = {"property_address": cell(shown(line), 0.80), "city": cell(F.when(~town.rlike(FORM_WORDS), town), 0.75), "state": cell(F.upper(part(zone, r"(?i)State[:\s]*([A-Z]{2})\b")), 0.80), "zip_code": cell(lone, 0.80)}
        return F.struct(*[c.alias(n) for n, c in cells.items()])

    start = F.greatest(F.regexp_instr(text, F.lit(r"(?i)Property Address"), 0), F.lit(1))
    found = let(F.coalesce(*[part(text, p) for p in LAYOUTS]), lambda line: F.when(part(line, ZIP).isNotNull(), peeled(line)).when(line.isNotNull(), let(F.substring(text, start, F.lit(ZONE)), lambda zone: scattered(line, zone))))
    return found
