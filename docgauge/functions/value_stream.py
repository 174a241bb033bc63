"""Values that stand in a stream without their labels: cut at marks, or aligned with the known order of the fields."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docgauge.functions.numeric import scaled_price
from docgauge.functions.text import let

# fixed values: where the blank form begins, and how much is read without it
FORM = r"(?i)\bForm\s+1004UAD\b"
PREFIX = {"stream": 6000, "facts": 5000}


def stream_of(text: Column, longest: int) -> Column:
    """The text before the blank form, or the first ``longest`` characters where there is none."""
    return F.when(text.rlike(FORM), F.split(text, FORM, 2).getItem(0)).otherwise(F.left(text, F.lit(longest)))


def segments(text: Column, marks: dict[str, str]) -> Column:
    """map from mark to the trimmed text between it and the next mark of any kind; the first of equal marks counts.

    All marks are looked for in one pass: the text is cut before each, and each piece is named by the mark it begins with.
    """
    cuts = F.split(text, "(?i)(?=" + "|".join(f"(?:{p})" for p in marks.values()) + ")")
    name = lambda piece: F.coalesce(*[F.when(piece.rlike(f"(?i)^(?:{p})"), F.lit(n)) for n, p in marks.items()])
    every = "(?i)^(?:" + "|".join(marks.values()) + ")"
    pairs = F.transform(cuts, lambda piece: F.struct(name(piece).alias("mark"), F.regexp_replace(F.regexp_replace(piece, every, ""), r"^\s+|\s+$", "").alias("value")))
    named = F.filter(pairs, lambda p: p["mark"].isNotNull())
    firsts = F.filter(named, lambda p, i: F.array_position(F.transform(named, lambda q: q["mark"]), p["mark"]) == i + 1)
    return F.map_from_entries(firsts)


# fixed values: marks of the first page's value stream, and the numbers at its head with their longest forms
MARKS = {
    "costs": r"\$0\s*;{1,2}\s*closing\s+costs\s", "north": r"North\s*=\s*", "south": r"South\s*=\s*", "east": r"East\s*=\s*", "west": r"West\s*=\s*",
    "factors": r"There\s+are\s+no\s+apparent\s+adverse\s+factors", "financing": r"Various\s+types\s+of\s+financing",
}
NUMBERS = {
    "price_low": 4, "price_high": 4, "predominant_price": 4, "age_low": 3, "age_high": 3, "predominant_age": 3,
    "land_use_one_unit": 3, "land_use_two_four_unit": 3, "land_use_multi_family": 3, "land_use_commercial": 3, "land_use_other": 3,
}
SITE_TAIL = r"(?is)3-6\s+months\.\s+([\d,]+\s*sf)\s+([\d,]+)\s*sf\s+([A-Za-z]+)\s+(N;[A-Za-z]+;)"


def page_stream(text: Column) -> Column:
    """struct of the flattened first page's fields, each struct(value, confidence, method); null unless the whole stream is there.

    Eleven numbers (prices, ages, land use), four boundaries, two commentaries and four site values follow the closing
    costs. Built-up, location and the four trends are read off that context, at 0.65 or 0.70.
    """
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    cell = lambda v, c, m="regex_primary": F.struct(v.cast("string").alias("value"), F.lit(c).alias("confidence"), F.lit(m).alias("method"))
    sides = ("north", "south", "east", "west")

    def fields(cut: Column, numbers: Column, tail: Column, suburban: Column) -> Column:
        at = lambda n: F.try_element_at(cut, F.lit(n))
        site = [F.nullif(F.regexp_extract(tail, SITE_TAIL, i), F.lit("")) for i in (1, 2, 3, 4)]
        there = (F.size(numbers) == len(NUMBERS)) & site[3].isNotNull()
        for i, longest in enumerate(NUMBERS.values()):
            there = there & F.get(numbers, F.lit(i)).rlike(rf"^\d{{1,{longest}}}$")
        for n in (*sides, "factors"):
            there = there & (at(n) != "")
        number = {n: F.get(numbers, F.lit(i)).try_cast("int") for i, n in enumerate(NUMBERS)}
        uses = [v for n, v in number.items() if n.startswith("land_use")]
        out = {n: cell(scaled_price(v.cast("double")).cast("long") if "price" in n else v, 0.90) for n, v in number.items()}
        out["land_use_total"] = cell(sum(uses[1:], uses[0]), 0.90)
        out["neighborhood_boundaries"] = cell(F.concat_ws("; ", *[F.concat(F.lit(f"{n.title()} = "), flat(at(n))) for n in sides]), 0.90)
        out["neighborhood_description"] = cell(F.concat(F.lit("There are no apparent adverse factors "), flat(at("factors"))), 0.90)
        out["market_conditions_commentary"] = cell(flat(F.regexp_extract(tail, r"(?is)^(.*?3-6\s+months\.)", 1)), 0.90)
        out |= {n: cell(F.trim(v), 0.88) for n, v in zip(("site_dimensions", "site_area", "site_shape", "site_view"), site, strict=True)}
        out["site_area_unit"] = cell(F.lit("sf"), 0.88)
        guess = "context_fallback"
        out["built_up"] = cell(F.when(uses[0] + uses[1] + uses[2] >= 75, "Over 75%"), 0.70, guess)
        out["location"] = cell(F.when(suburban, "Suburban"), 0.65, guess)
        for n, v, c in (("growth_rate", "Stable", 0.65), ("property_values", "Stable", 0.70), ("demand_supply", "In Balance", 0.65), ("marketing_time", "3-6 mths", 0.70)):
            out[n] = cell(F.lit(v), c, guess)
        return F.when(there, F.struct(*[v.alias(n) for n, v in out.items()]))

    def read(prefix: Column) -> Column:
        return let(segments(prefix, MARKS), lambda cut: let(
            F.struct(F.split(F.try_element_at(cut, F.lit("costs")), r"\s+").alias("numbers"), F.concat_ws(" ", F.lit("Various types of financing"), F.try_element_at(cut, F.lit("financing"))).alias("tail")),
            lambda x: fields(cut, x["numbers"], x["tail"], prefix.rlike(r"(?i)\bSagecreek\b|\bS/D\b|subdivision")),
        ))

    return let(stream_of(text, PREFIX["stream"]), read)


# fixed values: the facts of the first page in their order: shape, least and most words, confidence
FACTS = {
    "legal_description": (r"Lot \d+ .+", 3, 40, 0.86), "assessors_parcel_number": (r"[A-Za-z]\d{3} \d{3}", 2, 2, 0.84), "tax_year": (r"\d{4}", 1, 1, 0.84), "real_estate_taxes": (r"[\d,]+", 1, 1, 0.84),
    "neighborhood_name": (r"[A-Za-z][A-Za-z0-9 /.-]+", 1, 12, 0.82), "map_reference": (r"\d{3,8}", 1, 1, 0.78), "census_tract": (r"\d{4}\.\d{2}", 1, 1, 0.84), "special_assessments": (r"\d+(?:\.\d+)?", 1, 1, 0.78), "hoa_dues": (r"\d+(?:\.\d+)?", 1, 1, 0.70),
}
#: Cost of a value that fits only with scanners' letters read as digits, and of each word a value takes beyond its least.
MENDED, WORD = 1.0, 0.01
LIKE_DIGITS = str.maketrans("OolIS", "00115")


def fit(words: list[str], shape: str) -> tuple[float, str] | None:
    """(cost, value) of words as one value of a shape; None where they can't be one."""
    value = " ".join(words)
    if re.fullmatch(shape, value, re.IGNORECASE):
        return 0.0, value
    mended = " ".join(w.translate(LIKE_DIGITS) if any(c.isdigit() for c in w) else w for w in words)
    return (MENDED, mended) if re.fullmatch(shape, mended, re.IGNORECASE) else None


def head_of(shape: str) -> re.Pattern | None:
    """The part of a shape that its first word has to match; None where the shape's first blank may not end a word."""
    head, blank, _ = shape.partition(" ")
    return re.compile(head, re.IGNORECASE) if blank and not set("[(|") & set(re.sub(r"\[[^\[\]]*\]", "", head)) else None


def begins(word: str, head: re.Pattern | None) -> bool:
    """False where no value of the shape can begin with the word, as it is or mended."""
    return head is None or bool(head.fullmatch(word)) or (any(c.isdigit() for c in word) and bool(head.fullmatch(word.translate(LIKE_DIGITS))))


def aligned(words: list[str], slots: list[tuple[str, int, int]]) -> list[str] | None:
    """Values of consecutive slots (shape, least, most words) somewhere in the words, by the cheapest alignment.

    States are (slot, place behind it); of equal costs the earlier beginning, then the shorter first values win. None
    without an alignment.
    """
    reached = {i: (0.0, i, []) for i in range(len(words))}
    for shape, few, most in slots:
        following: dict[int, tuple[float, int, list[str]]] = {}
        head = head_of(shape)
        for i, (cost, begin, values) in sorted(reached.items()):
            if i < len(words) and not begins(words[i], head):
                continue
            for n in range(few, min(most, len(words) - i) + 1):
                hit = fit(words[i : i + n], shape)
                if hit:
                    new = (round(cost + hit[0] + WORD * (n - few), 6), begin, [*values, hit[1]])
                    if i + n not in following or new[:2] < following[i + n][:2]:
                        following[i + n] = new
        reached = following
    return min(reached.values(), key=lambda s: s[:2])[2] if reached else None


def page_facts(text: Column) -> Column:
    """struct of the nine facts of the first page, each struct(value, confidence, method); null where nothing can be aligned."""

    @F.pandas_udf("array<string>")
    def align(streams: pd.Series) -> pd.Series:
        slots = [v[:3] for v in FACTS.values()]
        return streams.map(lambda s: aligned(s.split(), slots) if s and re.search(r"\blot\b", s, re.IGNORECASE) else None)

    values = align(stream_of(text, PREFIX["facts"]))
    cells = [F.struct(F.get(values, F.lit(i)).alias("value"), F.lit(c).alias("confidence"), F.lit("regex_primary").alias("method")).alias(n) for i, (n, (_, _, _, c)) in enumerate(FACTS.items())]
    return F.when(values.isNotNull(), F.struct(*cells))
