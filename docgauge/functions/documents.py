"""Field ladders: text of a document to typed values with confidence and method."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(text: Column, patterns: list[str], labels: tuple[str, ...] = ()) -> Column:
    """struct(value, confidence, method) of the first pattern whose group 1 is neither blank nor itself a form label.

    Confidence falls by 0.10 with each step from 0.88, to 0.30 at least; without a match the value is null, "not_found".
    """
    found = None
    for i, p in enumerate(patterns):
        v = F.trim(F.regexp_extract(text, p, 1))
        ok = (v != "") & ~F.lower(v).isin([x.lower() for x in labels] or ["\x00"])
        row = F.struct(v.alias("value"), F.lit(max(0.30, round(0.88 - 0.10 * i, 2))).alias("confidence"), F.lit("regex_primary" if i == 0 else "regex_fallback").alias("method"))
        found = F.when(ok, row) if found is None else found.when(ok, row)
    return found.otherwise(F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit("not_found").alias("method")))


def section(text: Column, start: str, end: str) -> Column:
    """Text between two patterns."""
    return F.regexp_extract(text, f"(?is){start}(.*?)(?:{end})", 1)


# fixed values: names by which a form is known, in the order in which they are tried
FORMS = {
    "1004": "Uniform Residential Appraisal Report|URAR|Form 1004",
    "1025": "Small Residential Income Property|Form 1025",
    "1073": "Individual Condominium|Form 1073",
    "2055": "Exterior-Only Inspection|Form 2055",
}


def form_type(text: Column) -> Column:
    """The first form that the text names, null if it names none."""
    return F.coalesce(*[F.when(text.rlike("(?i)" + names), F.lit(form)) for form, names in FORMS.items()])


def address_parts(text: Column) -> Column:
    """struct(street, city, state, zip) of a one-line address."""
    zip_ = F.regexp_extract(text, r"\b(\d{5})(?:-\d{4})?\s*$", 1)
    state = F.regexp_extract(text, r"\b([A-Z]{2})\s+\d{5}(?:-\d{4})?\s*$", 1)
    head = F.regexp_replace(text, r",?\s*[A-Z]{2}\s+\d{5}(-\d{4})?\s*$", "")
    city = F.trim(F.when(F.contains(head, F.lit(",")), F.substring_index(head, ",", -1)).otherwise(""))
    street = F.trim(F.regexp_replace(head, r",[^,]*$", ""))
    null = lambda c: F.nullif(c, F.lit(""))
    return F.struct(null(street).alias("street"), null(city).alias("city"), null(state).alias("state"), null(zip_).alias("zip"))


# fixed values: words of a page that was read well
PAGE_TERMS = "property address borrower value appraisal comparable sales neighborhood condition".split()


def page_confidence(text: Column, terms: list[str] = PAGE_TERMS) -> Column:
    """0.5 plus 0.05 a known term (0.3 at most), less 0.2 where over a tenth is odd characters and 0.1 where over three
    numbers have ten digits or more; between 0.1 and 1, and 0.1 for pages of under 20 characters."""
    hit = F.aggregate(F.array(*[F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms]), F.lit(0), lambda a, x: a + x)
    odd = F.regexp_count(text, F.lit(r"(?U)[^\w\s.,;:$%()-]")) / F.greatest(F.length(text), F.lit(1)) > 0.1
    runs = F.regexp_count(text, F.lit(r"[0-9]{10,}")) > 3
    score = 0.5 + F.least(F.lit(0.3), 0.05 * hit) - F.when(odd, 0.2).otherwise(0.0) - F.when(runs, 0.1).otherwise(0.0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) < 20, 0.1).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)))


def document_confidence(key_fields: list[Column], other_fields: list[Column], text: Column) -> Column:
    """0.5 plus 0.1 a key field and 0.05 another field that is there, less 0.2 for under 1,000 characters; within 0 and 1."""
    there = lambda c: F.coalesce((c != "").cast("int"), F.lit(0))
    score = 0.5 + 0.1 * sum(map(there, key_fields), F.lit(0)) + 0.05 * sum(map(there, other_fields), F.lit(0)) - F.when(F.coalesce(F.length(text), F.lit(0)) < 1000, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def answer_json(response: Column, schema: str) -> Column:
    """struct(answer, error): the first to the last brace of a model's reply under a schema; no_response or unparseable."""
    raw = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(raw != "", raw), schema, {"mode": "PERMISSIVE"})
    bad = (raw == "") | F.try_parse_json(raw).isNull()
    error = F.when(F.coalesce(response, F.lit("")) == "", "no_response").when(bad, "unparseable")
    return F.struct(F.when(error.isNull(), parsed).alias("answer"), error.alias("error"))


def answer_confidence(label: Column) -> Column:
    """high, very high or true 0.90; medium or moderate 0.75; anything else 0.60."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(low.isin("high", "very high", "true"), 0.90).when(low.isin("medium", "moderate"), 0.75).otherwise(0.60)


def excerpt(text: Column, terms: list[str], limit: int = 2200, before: int = 450, after: int = 1000) -> Column:
    """The surroundings of each term's first place, parted by blank lines; the text's beginning where none occurs."""
    spots = F.array(*[F.locate(t.lower(), F.lower(text)) for t in terms])
    cut = F.transform(F.filter(spots, lambda p: p > 0), lambda p: F.substring(text, F.greatest(p - before, F.lit(1)), p + after - F.greatest(p - before, F.lit(1))))
    return F.left(F.when(F.size(cut) > 0, F.array_join(cut, "\n\n")).otherwise(text), F.lit(limit))


def mismatched_tokens(value: Column, other: Column) -> Column:
    """Distinct words of one value that the other lacks, without case and outer punctuation."""
    words = lambda c: F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\s,;:()\[\]{}]+"), lambda t: F.regexp_replace(t, r"^[^\w.%-]+|[^\w.%-]+$", "")), lambda t: t != "")
    return F.array_except(words(value), words(other))
