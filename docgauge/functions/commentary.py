"""Keyword scores of free-text commentary, as sums of pattern tests in one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.text import let


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur, ignoring case."""
    return F.aggregate(F.array(*[text.rlike("(?i)" + p).cast("int") for p in patterns]), F.lit(0), lambda a, x: a + x)


def canned(text: Column, phrases: list[str], specific: list[str], reasons: list[str]) -> Column:
    """struct(canned, confidence): stock phrases against specific facts and reasons.

    Two facts or three reasons: not canned (0.8). Two stock phrases: canned (0.75). Otherwise canned where
    0.3 per phrase less 0.2 per fact and 0.1 per reason passes 0.2 (0.5). Empty text is canned (0.9).
    """
    counts = F.struct(hits(text, phrases).alias("c"), hits(text, specific).alias("s"), hits(text, reasons).alias("r"))
    row = lambda flag, conf: F.struct(flag.cast("boolean").alias("canned"), F.lit(conf).alias("confidence"))

    def judged(n: Column) -> Column:
        c, s, r = n["c"], n["s"], n["r"]
        return F.when((s >= 2) | (r >= 3), row(F.lit(False), 0.8)).when(c >= 2, row(F.lit(True), 0.75)).otherwise(row(0.3 * c - 0.2 * s - 0.1 * r > 0.2, 0.5))

    return F.when(text.isNull() | (F.trim(text) == ""), row(F.lit(True), 0.9)).otherwise(let(counts, judged))


def template_score(text: Column, phrases: list[str], specific: list[str]) -> Column:
    """0.3 a stock phrase up to 1, halved by any specific fact; 0 for texts under 20 characters."""
    raw = F.least(F.lit(1.0), 0.3 * hits(text, phrases))
    return F.when(F.length(text) < 20, 0.0).otherwise(F.when(hits(text, specific) > 0, raw * 0.5).otherwise(raw))


def reasoning_score(text: Column, indicators: list[str], specific: list[str]) -> Column:
    """Indicators per hundred words, 0.3 each, plus 0.2 for a specific fact, at most 1; 0 under ten words."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    found = F.aggregate(F.array(*[F.regexp_count(text, F.lit("(?i)" + p)) for p in indicators]), F.lit(0), lambda a, x: a + x)
    score = found / (words / 100.0) * 0.3 + F.when(hits(text, specific) > 0, 0.2).otherwise(0.0)
    return F.when(words < 10, 0.0).otherwise(F.least(F.lit(1.0), score))


def keyword_groups(text: Column, groups: dict[str, list[str]]) -> Column:
    """Map of group name to the group's keywords that the text holds."""
    low = F.lower(text)
    found = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return F.create_map(*[x for name, words in groups.items() for x in (F.lit(name), found(words))])


def analysis(text: Column, phrases: list[str], specific: list[str], reasons: list[str], trends: dict[str, list[str]]) -> Column:
    """All findings on a text: stock phrases, reasoning (from 0.3 on), facts, trend groups that occur, words.

    A null text is canned, as an empty one is, and has no words, trends or reasoning.
    """
    plain = F.coalesce(text, F.lit(""))
    stock = canned(plain, phrases, specific, reasons)
    score = reasoning_score(plain, reasons, specific)
    named = F.array(*[F.when(plain.rlike("(?i)" + p), F.lit(p)) for p in phrases])
    return F.struct(
        stock["canned"].alias("is_canned"),
        stock["confidence"].alias("canned_confidence"),
        F.filter(named, lambda p: p.isNotNull()).alias("matched_templates"),
        (score >= 0.3).alias("has_reasoning"),
        score.alias("reasoning_score"),
        (hits(plain, specific) > 0).alias("has_specific_details"),
        F.map_filter(keyword_groups(plain, trends), lambda _, found: F.size(found) > 0).alias("market_trends"),
        F.size(F.filter(F.split(plain, r"\s+"), lambda w: w != "")).alias("word_count"),
    )
