"""String functions on columns: keys, tokens, ladders, masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that a match key leaves out, its rewrites of street suffixes, and what it drops behind them
KEY_WORDS = "purchase agreement contract order form appraisal report pdf".split()
REWRITES = {"tr": "trace terrace", "ct": "court", "cir": "circle", "st": "street", "rd": "road", "ave": "avenue"}
DROPPED = "north south east west n s e w ne nw se sw ct cir st rd ave dr ln way".split()



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(c: Column) -> Column:
    """Lower case for literals of ASCII: no sign beyond ASCII becomes one of it, as in patterns that ignore case."""
    for sign in ("\u0130", "\u212a"):  # the only ones whose lower case holds a letter of ASCII
        c = F.replace(c, F.lit(sign), F.lit("\u00b7"))
    return F.lower(c)


def any_word(words: list[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c)


def first_match(c: Column, patterns: list[str]) -> Column:
    """Group 1, trimmed, of the first pattern in order that finds a non-blank value; null if none does."""
    return F.coalesce(*[blank_to_null(F.trim(F.regexp_extract(c, p, 1))) for p in patterns])


def alnum_key(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def upper_key(c: Column) -> Column:
    """Upper case, trimmed, letters, digits and white space only."""
    return F.regexp_replace(F.upper(F.trim(c)), r"[^A-Z0-9\s]", "")


def squeezed(c: Column) -> Column:
    """Lower case with single spaces; blank is null."""
    return blank_to_null(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")))


def order_id(filename: Column) -> Column:
    """The text behind the last underscore of a file name without extension; the whole name if that is empty."""
    base = F.regexp_replace(filename, r"\.[^.]+$", "")
    tail = F.substring_index(base, "_", -1)
    return F.when(F.trim(filename) != "", F.when(tail == "", base).otherwise(tail))


def order_id_backfill(filename: Column) -> Column:
    """The bulk variant: nested replacements, an empty tail stays empty."""
    return F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"^.*_", "")


def match_key(filename: Column) -> Column:
    """The words of a file name that tell orders apart; a null name has an empty key."""
    c = F.regexp_replace(F.lower(F.coalesce(filename, F.lit(""))), r"\.[^.]+$", "")
    c = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", " "), any_word(KEY_WORDS), " ")
    for short, long in REWRITES.items():
        c = F.regexp_replace(c, any_word(long.split()), short)
    return F.trim(F.regexp_replace(F.regexp_replace(c, any_word(DROPPED), " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Distinct non-empty words of a key, in order."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda t: t != ""))


def match_score(a: Column, b: Column) -> Column:
    """100 for equal keys, 50 where one contains the other (an empty key is in every key), else the token overlap.

    The overlap counts only if it holds a number and a token that is none.
    """
    both = F.array_intersect(tokens(a), tokens(b))
    mixed = F.exists(both, lambda t: t.rlike("^[0-9]+$")) & F.exists(both, lambda t: ~t.rlike("^[0-9]+$"))
    return F.when(a == b, 100).when(F.contains(a, b) | F.contains(b, a), 50).when(mixed, F.size(both)).otherwise(0)


def contains_folded(c: Column, needle: str) -> Column:
    """Case-insensitive LIKE %needle%; % and _ in the needle are wildcards, as in the finders."""
    return F.lower(c).like("%" + needle.lower() + "%")


def checkbox_state(text: Column, label: str) -> Column:
    """True for a marked box before the label, false for an empty one, null where there is none."""
    return F.when(text.rlike(rf"(?i)\[\s*x\s*\]\s*{label}"), True).when(text.rlike(rf"(?i)\[\s*\]\s*{label}"), False)


def digits_for_letters(c: Column) -> Column:
    """Letters that scanners put for digits: O between digits is 0, l between digits is 1."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=[0-9])[Oo](?=[0-9])", "0"), r"(?<=[0-9])l(?=[0-9])", "1")


def display_name(full_name: Column, username: Column) -> Column:
    return F.coalesce(blank_to_null(full_name), username)


def quality_flags(**flags: Column) -> Column:
    """Names of the true flags, one a line; null if none is."""
    named = F.array(*[F.when(c, F.lit(n.replace("_", " "))) for n, c in flags.items()])
    return blank_to_null(F.array_join(F.filter(named, lambda x: x.isNotNull()), "\n"))


# fixed values: short forms of street words, and the words that say little about a street
SHORT = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "CIRCLE": "CIR", "COURT": "CT", "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD",
    "DRIVE": "DR", "ROAD": "RD", "LANE": "LN", "TERRACE": "TER", "TRACE": "TR", "PLACE": "PL", "PARKWAY": "PKWY", "HIGHWAY": "HWY",
}
DIRECTIONS = ["N", "S", "E", "W", "NE", "NW", "SE", "SW"]
PLAIN = "ST AVE BLVD DR RD LN CT CIR TER TR PL PKWY HWY N S E W".split()


def street_tokens(c: Column) -> Column:
    """Upper-case words of a street in their short forms; a direction behind the house number goes to the end."""
    words = F.filter(F.split(upper_key(c), r"\s+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    short = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
    moved = F.concat(F.slice(short, 1, 1), F.slice(short, F.lit(3), F.greatest(F.size(short) - 2, F.lit(0))), F.slice(short, 2, 1))
    return F.when((F.size(short) > 2) & F.get(short, F.lit(1)).isin(DIRECTIONS), moved).otherwise(short)


def same_street(a: Column, b: Column) -> Column:
    """Equal house numbers and a shared word that is neither a street type nor a direction, over ``street_tokens``."""
    plain = F.array(*[F.lit(w) for w in PLAIN])
    core = lambda t: F.array_except(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), plain)
    return F.coalesce((F.size(a) > 0) & (F.get(a, F.lit(0)) == F.get(b, F.lit(0))) & F.arrays_overlap(core(a), core(b)), F.lit(False))


def census_tract(c: Column) -> Column:
    """dddd.dd: kept if it is in that form, rebuilt from four digits or more, else the trimmed input."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    made = F.concat(F.left(digits, F.lit(4)), F.lit("."), F.rpad(F.substring(digits, 5, 2), 2, "0"))
    return F.when(F.trim(c).rlike(r"^\d{4}\.\d{2}$") | (F.length(digits) < 4), F.trim(c)).otherwise(made)


def area_square_feet(c: Column) -> Column:
    """Number of an area text in square feet; acres are 43,560 of them; 0 where there is no number."""
    value = F.regexp_replace(F.regexp_extract(c, r"([\d,]+(?:\.\d+)?)", 1), ",", "").try_cast("double")
    return F.when(F.lower(c).contains("ac"), F.coalesce(value, F.lit(0.0)) * 43560).otherwise(F.coalesce(value, F.lit(0.0)))


# fixed values: names of fields in rule texts and the fields that they mean; the last two mean none
FIELD_NAMES = {
    "property_address_report": "property_address", "address": "property_address", "street": "property_address", "zip": "zip_code", "borrower": "borrower_name", "borrower_name_report": "borrower_name",
    "apn": "assessors_parcel_number", "pud": "is_pud_checked", "pud_checkbox": "is_pud_checked", "lender_name_report": "lender_name", "property_rights_appraised": "property_rights",
    "prior_sale_offered_status": "offered_for_sale_12mo", "prior_sale_offered_12mo": "offered_for_sale_12mo", "data_sources": "data_source", "client_engagement_letter": None, "property_address_engagement_letter": None,
}


def field_name(c: Column) -> Column:
    """Field that a name in a rule's text means; unknown names in snake case, null for those that mean none."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\([^)]*\)", ""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = F.when(key.isin([k for k, v in FIELD_NAMES.items() if v is None]) | (F.trim(c) == ""), None)
    for name, means in FIELD_NAMES.items():
        if means:
            out = out.when(key == name, means)
    return out.otherwise(key)


def replaced(c: Column, table: dict[str, str]) -> Column:
    """Literal replacements in the table's order."""
    for old, new in table.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c
