"""Label and value pairs out of table cells, and keyword search over pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: labels of form tables, and further fragments that make a cell a label
LABELS = (
    "Owner of Public Record|Property Rights Appraised|Assessor's Parcel #|Legal Description|Neighborhood Name|Special Assessments|Map Reference|Census Tract|Property Address|Date of Contract|Lender/Client|"
    "R.E. Taxes $|Tax Year|Borrower|County|Address|City|State|Zip Code|Zip|Occupant|PUD"
).split("|")
FRAGMENTS = ["sale price", "proximity", "site", "view", "design", "quality", "condition", "gross living area"]
#: The longest label wins where one holds another.
ANY_LABEL = "(?i)(?<![A-Za-z0-9])(" + "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(LABELS, key=len, reverse=True)) + ")(?![A-Za-z0-9])"


def clean(cell: Column) -> Column:
    """Single spaces, without outer space and bars; null is empty."""
    return F.btrim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "), F.lit(" |"))


def is_label(cell: Column) -> Column:
    low = F.lower(cell)
    return (cell != "") & (F.length(cell) <= 80) & F.exists(F.array(*[F.lit(x) for x in [*map(str.lower, LABELS), *FRAGMENTS]]), lambda x: F.contains(low, x))


def is_value(cell: Column) -> Column:
    return (cell != "") & (F.length(cell) <= 180) & ~is_label(cell) & cell.rlike("[A-Za-z0-9$]")


def label_values(rows: DataFrame, keys: list[str], row: str = "row", cells: str = "cells") -> DataFrame:
    """(keys, label, value) in order of first occurrence, from tables given as rows of cells (array of string).

    A pair is a label cell with the value cell to its right, labels inside one cell with what follows each, or a row of
    two labels or more with the values of the next row in the same columns. An Address behind a Lender/Client in one
    cell is the Lender Address. Pairs that differ in case only count once; null and empty tables give none.
    """
    table = rows.select(*keys, F.col(row).alias("_row"), F.transform(cells, clean).alias("_cells")).where(F.exists("_cells", lambda c: c != ""))
    table = table.withColumn("_next", F.lead("_cells").over(Window.partitionBy(*keys).orderBy("_row")))
    pair = lambda label, value: F.struct(F.rtrim(F.regexp_replace(label, ":+$", "")).alias("label"), value.alias("value"))
    both = lambda a, b: F.filter(F.arrays_zip(a.alias("l"), b.alias("v")), lambda p: F.coalesce(is_label(p["l"]) & is_value(p["v"]), F.lit(False)))
    beside = both(F.col("_cells"), F.slice("_cells", F.lit(2), F.greatest(F.size("_cells") - 1, F.lit(0))))
    columns = F.least(F.size("_cells"), F.size("_next"))
    upper, lower = F.slice("_cells", F.lit(1), columns), F.slice("_next", F.lit(1), columns)
    headed = (F.size(F.filter(upper, is_label)) >= 2) & F.exists(lower, is_value)
    below = F.when(F.col("_next").isNotNull() & headed, both(upper, lower))

    def inline(cell: Column) -> Column:
        labels = F.regexp_extract_all(cell, F.lit(ANY_LABEL), 1)
        rest = F.slice(F.split(cell, ANY_LABEL), F.lit(2), F.size(labels))
        parts = F.transform(F.arrays_zip(labels.alias("l"), rest.alias("v")), lambda p, i: F.struct(F.when((F.lower(p["l"]) == "address") & (i > 0) & (F.lower(F.get(labels, i - 1)) == "lender/client"), "Lender Address").otherwise(p["l"]).alias("l"), F.trim(F.regexp_replace(F.regexp_replace(p["v"], r"^[\s:.-]+", ""), r"[\s|]+$", "")).alias("v")))
        return F.when(F.size(labels) >= 2, F.filter(parts, lambda p: is_value(p["v"])))

    none = F.expr("cast(array() as array<struct<l:string,v:string>>)")
    found = F.concat(beside, F.flatten(F.transform("_cells", lambda c: F.coalesce(inline(c), none))), F.coalesce(below, none))
    out = table.select(*keys, "_row", F.posexplode(F.transform(found, lambda p: pair(p["l"], p["v"]))).alias("_at", "_p"))
    first = Window.partitionBy(*keys, F.lower("_p.label"), F.lower("_p.value")).orderBy("_row", "_at")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").orderBy(*keys, "_row", "_at").select(*keys, "_p.label", "_p.value")


def pages_with(pages: DataFrame, doc: str, page: str, text: str, keywords: list[str], most: int, need_all: bool = False) -> DataFrame:
    """Pages of each document by how many of the keywords they hold, most first, then by page; at most ``most`` each."""
    score = sum((F.coalesce(F.contains(F.lower(text), F.lit(k.lower())), F.lit(False)).cast("int") for k in keywords), F.lit(0))
    hit = pages.select(doc, page, score.alias("score")).where(F.col("score") >= (len(keywords) if need_all else 1))
    ranked = hit.withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), page)))
    return ranked.where(F.col("_r") <= most).drop("_r")


def pages_matching(pages: DataFrame, doc: str, page: str, text: str, pattern: str, most: int = 10) -> DataFrame:
    """Pages of each document by how often the pattern matches, ties by page; at most ``most`` each."""
    hit = pages.select(doc, page, F.regexp_count(text, F.lit("(?i)" + pattern)).alias("score")).where("score > 0")
    ranked = hit.withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), page)))
    return ranked.where(F.col("_r") <= most).drop("_r")


def missing_pages(pages: DataFrame, expected: DataFrame, doc: str = "doc_id", page: str = "page", count: str = "page_count") -> DataFrame:
    """(doc, missing array) of documents whose pages 1..count are not all there."""
    there = pages.groupBy(doc).agg(F.collect_set(page).alias("_there"))
    lack = expected.where(F.col(count) > 0).join(there, doc, "left").select(doc, F.array_except(F.sequence(F.lit(1), F.col(count).cast("int")), F.coalesce("_there", F.expr("cast(array() as array<int>)"))).alias("missing"))
    return lack.where(F.size("missing") > 0)
