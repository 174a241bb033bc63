"""Date ladders: the first format that parses wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMM d, yyyy")


def two_digit_year(c: Column, pivot: int) -> Column:
    """M/d/yy with years below the pivot in the 2000s."""
    parts = F.split(c, "[/-]")
    yy = F.element_at(parts, 3).try_cast("int")
    year = F.when(yy < pivot, yy + 2000).otherwise(yy + 1900)
    made = F.concat_ws("-", year.cast("string"), F.element_at(parts, 1), F.element_at(parts, 2))
    return F.when(c.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2}$"), F.try_to_timestamp(made, F.lit("yyyy-M-d")).cast("date"))


def parse_date(c: Column, formats: tuple[str, ...] = FORMATS, pivot: int = 70) -> Column:
    """A date by the first format that parses, else by two-digit years around ``pivot``, else null."""
    c = F.trim(c)
    shape = {"yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$", "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$"}
    tries = [F.when(c.rlike(shape.get(f, r"^[A-Za-z]{3,} \d{1,2}, \d{4}$")), F.try_to_timestamp(c, F.lit(f)).cast("date")) for f in formats]
    return F.coalesce(*tries, two_digit_year(c, pivot))


def parse_date_or_text(c: Column, pivot: int = 70) -> Column:
    """ISO text of the date, or the input where nothing parses."""
    return F.coalesce(parse_date(c, pivot=pivot).cast("string"), c)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, never negative."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / 60)).cast("long")


def age_label(minutes: Column) -> Column:
    """12m, 3h or 2d."""
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d")))
