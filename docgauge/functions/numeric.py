"""Rounding and ratio helpers. Three rounding rules meet in this domain; each has its own name here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up_floor(c: Column, digits: int = 1) -> Column:
    """floor(x * 10**d + 0.5) / 10**d: the dashboard's rule, also for negative values."""
    scale = 10**digits
    return F.floor(c * scale + F.lit(0.5)) / F.lit(float(scale))


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Banker's rounding, the scripting side's rule."""
    return F.bround(c, digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole by the dashboard's rule, 0 where there is no whole."""
    return F.when(whole > 0, round_half_up_floor(part * F.lit(100.0) / whole, digits)).otherwise(F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def parse_money(c: Column) -> Column:
    """Amount with $ and commas as double; null where nothing parses."""
    return F.nullif(F.regexp_replace(c, r"[$,\s]", ""), F.lit("")).try_cast("double")


def parse_number(c: Column) -> Column:
    """Keep digits, dot and minus, then parse."""
    return F.nullif(F.regexp_replace(c, r"[^0-9.\-]", ""), F.lit("")).try_cast("double")


def money_with_suffix(c: Column) -> Column:
    """Amount with a currency sign and an optional K, M or B."""
    s = F.upper(F.regexp_replace(c, r"[$€£,\s]", ""))
    scale = F.when(s.endswith("K"), 1e3).when(s.endswith("M"), 1e6).when(s.endswith("B"), 1e9).otherwise(1.0)
    return F.nullif(F.regexp_replace(s, r"[KMB]$", ""), F.lit("")).try_cast("double") * scale


def scaled_price(c: Column) -> Column:
    """Prices below 1000 are in thousands."""
    return F.when(c < 1000, c * 1000).otherwise(c)


def numeric_match(a: Column, b: Column) -> Column:
    """1 where the relative difference is at most 1 %, else 1 minus it, never below 0; equal zeros match."""
    rel = F.abs(a - b) / F.abs(b)
    return F.when(a.isNull() | b.isNull(), 0.0).when(b == 0, F.when(a == 0, 1.0).otherwise(0.0)).when(rel <= 0.01, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - rel))


def outcome(match: Column, confidence: Column) -> Column:
    """PASS, VERIFY or FAIL by the clamped product of match and confidence (0.98 and 0.70)."""
    combined = clamp(match * clamp(confidence))
    return F.when(combined >= 0.98, "PASS").when(combined >= 0.70, "VERIFY").otherwise("FAIL")


def effective_confidence(confidence: Column, sanity_failed: Column) -> Column:
    return F.greatest(F.lit(0.0), F.when(F.coalesce(sanity_failed, F.lit(False)), confidence - 0.25).otherwise(confidence))


def progress_percent(current: Column, total: Column) -> Column:
    """Whole percent, 0 without a total, within 0 and 100."""
    return F.when(total > 0, clamp(F.floor(current * 100.0 / total + 0.5), 0, 100)).otherwise(0).cast("int")
