"""Evidence, review lists and detections: lookups, picks, trims and scores as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.functions.dates import parse_date
from docgauge.functions.text import blank_to_null, let


def folded(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def match_of_kind(kind: Column, a: Column, b: Column) -> Column:
    """1 or 0 for the match types exact, checkbox, date and blank; an absent or blank side is 0, blank has no match."""
    bare = F.coalesce(F.trim(a) != "", F.lit(False)) & F.coalesce(F.trim(b) != "", F.lit(False))
    ticked = lambda c: ~F.lower(F.trim(c)).isin("", "false", "0", "no")
    hit = (
        F.when(kind == "checkbox", F.coalesce(ticked(a) == ticked(b), F.lit(False))).when(~bare, False)
        .when(kind == "exact", folded(a) == folded(b)).when(kind == "date", F.coalesce(parse_date(a) == parse_date(b), F.lit(False))).otherwise(False)
    )
    return hit.cast("double")


def proxy_letter(letter: dict[str, Column], report: dict[str, Column]) -> list[Column]:
    """The letter's columns, or where it has none at all the report's; a missing assignment type is then Refinance."""
    absent = F.lit(True)
    for c in letter.values():
        absent = absent & c.isNull()
    return [F.when(absent, F.coalesce(report[n], F.lit("Refinance")) if n == "assignment_type" else report[n]).otherwise(c).alias(n) for n, c in letter.items()]


def first_candidate(values: Column, names: list[str]) -> Column:
    """The first present value of a map, by the names' order."""
    return F.coalesce(*[blank_to_null(F.try_element_at(values, F.lit(n))) for n in names])


def value_confidence(values: Column, confidences: Column, name: str) -> Column:
    """A field's own confidence; without one 0.7, or 0 where there is no value."""
    return F.coalesce(F.try_element_at(confidences, F.lit(name)), F.when(F.try_element_at(values, F.lit(name)).isNull(), 0.0).otherwise(0.7))


def first_page_with(pages: DataFrame, terms: list[str], doc: str, page: str, text: str) -> DataFrame:
    """Rows (doc, term, page): of the terms in order, the first that any page holds, on its first page."""
    ranked = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(t).alias("term")) for i, t in enumerate(terms)])
    hits = pages.select(doc, F.col(page), F.explode(F.filter(ranked, lambda t: F.contains(F.lower(F.col(text)), F.lower(t["term"])))).alias("t"))
    return hits.groupBy(doc).agg(F.min(F.struct("t.rank", F.col(page).alias("page"), "t.term")).alias("m")).select(doc, F.col("m.term").alias("term"), F.col("m.page").alias(page))


def word_span(words: Column, value: Column, most: int = 12) -> Column:
    """(first, last) place from 1 of the value's words (at most ``most``) in a row, else of its first word; null without it."""
    want = F.slice(F.filter(F.split(F.lower(value), r"\s+"), lambda w: w != ""), 1, most)

    def found(low: Column, want: Column) -> Column:
        size = F.size(want)
        same = lambda i: F.forall(F.sequence(F.lit(0), size - 1), lambda j: F.coalesce(F.get(low, i + j - 1) == F.get(want, j), F.lit(False)))
        # the whole value is compared only where its first word stands, word by word, so that the cost is linear
        places = F.filter(F.transform(low, lambda w, i: F.when(w == F.get(want, F.lit(0)), i + 1)), lambda i: i.isNotNull())
        span = lambda places: F.struct(F.get(places, F.lit(0)).alias("single"), F.get(F.filter(places, same), F.lit(0)).alias("start"))
        pair = lambda s: F.when(s["start"].isNotNull(), F.struct(s["start"].alias("first"), (s["start"] + size - 1).alias("last"))).when(s["single"].isNotNull(), F.struct(s["single"].alias("first"), s["single"].alias("last")))
        return F.when(size > 0, let(let(places, span), pair))

    # both lists are worked out once a row
    return let(F.struct(F.transform(words, F.lower).alias("low"), want.alias("want")), lambda x: found(x["low"], x["want"]))


# fixed values: labels of the neighbouring cells of a person's name
NEXT_LABELS = r"(?is)\b(?:Owner of Public Record|Property Address|City|County|Legal Description|Assessor|Tax Year|Occupant|Map Reference|Census Tract|Lender|Client)\b.*"


def boundary_trim(value: Column, confidence: Column) -> list[Column]:
    """(value, confidence): cut before the next cell's label, single spaces, no outer marks; a corrected value has 0.78 at least."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, NEXT_LABELS, ""), r"\s+", " "), r"^[ :|-]+|[ :|-]+$", "")
    changed = F.coalesce((cut != "") & (cut != value), F.lit(False))
    return [F.when(changed, cut).otherwise(value).alias("value"), F.when(changed, F.greatest(confidence, F.lit(0.78))).otherwise(confidence).alias("confidence")]


def split_items(c: Column) -> Column:
    """Items between commas and semicolons, single spaces, no empty ones."""
    return F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def flag_lines(c: Column, prefix: str) -> Column:
    """The non-empty lines, each behind a prefix."""
    return F.transform(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))


def by_kind_then_name(kind: Column, order: list[str], name: Column) -> list[Column]:
    """Sort keys: a kind's place in the list (an absent one 99), then the name, null as empty."""
    place = F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(order)], F.lit(99))
    return [place.asc(), F.coalesce(name, F.lit("")).asc()]


def next_action(alerts: DataFrame, count: str, order: str) -> DataFrame:
    """The first alert with a count above zero."""
    return alerts.where(F.col(count) > 0).orderBy(order).limit(1)


def run_summary(jobs: DataFrame, done: Column, seconds: Column) -> DataFrame:
    """Jobs, completed ones, their average, least and most seconds, and the share completed in percent."""
    of = F.when(done, seconds)
    return jobs.agg(F.count("*").alias("jobs"), F.count(of).alias("completed"), F.avg(of).alias("avg_s"), F.min(of).alias("min_s"), F.max(of).alias("max_s"), (F.count(of) * 100.0 / F.count("*")).alias("success_pct"))


def with_sub_progress(parents: DataFrame, updates: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Parents with the latest sub-progress of their key, if any; updates without a parent are dropped."""
    latest = updates.groupBy(key).agg(F.max_by(value, at).alias("sub_progress"))
    return parents.join(latest, key, "left")


def checked_option(detections: DataFrame, group: str, option: str, checked: Column, confidence: str) -> DataFrame:
    """Per group its checked option of the highest confidence above 0, the first by name among equals."""
    best = detections.where(checked & (F.col(confidence) > 0)).groupBy(group).agg(F.min(F.struct((-F.col(confidence)).alias("c"), F.col(option).alias("o"))).alias("m"))
    return best.select(group, F.col("m.o").alias(option))


def typed_valid(kind: Column, value: Column, low: Column, high: Column) -> Column:
    """Whether a text is a valid currency, number, year or date; amounts lie within low and high where these are given."""
    n = F.regexp_replace(value, r"[$,\s]", "").try_cast("double")
    inside = n.isNotNull() & (low.isNull() | (n >= low)) & (high.isNull() | (n <= high))
    year = value.rlike(r"^\s*(19|20)\d{2}\s*$")
    return F.coalesce(F.when(kind.isin("currency", "number"), inside).when(kind == "year", year).when(kind == "date", parse_date(value).isNotNull()).otherwise(F.trim(value) != ""), F.lit(False))


def canonical(value: Column, known: list[str]) -> Column:
    """The known spelling of a value: equal but for case and outer spaces, else of equal length with two differing signs at most."""
    up = F.upper(F.trim(value))
    signs = lambda c: F.split(c, "")
    differing = lambda k: F.aggregate(F.zip_with(signs(up), signs(F.lit(k.upper())), lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x)
    near = [F.when((F.length(up) == len(k)) & (differing(k) <= 2), F.lit(k)) for k in known]
    return F.when(F.trim(value) == "", value).otherwise(F.coalesce(*[F.when(up == k.upper(), F.lit(k)) for k in known], *near, value))


def accuracy(fields: DataFrame, valid: Column, critical: Column) -> DataFrame:
    """Fields, valid ones, and percent valid of all and of the critical ones (0 without any)."""
    share = lambda part, whole: F.coalesce(F.count(F.when(part, 1)) * 100.0 / F.nullif(F.count(F.when(whole, 1)), F.lit(0)), F.lit(0.0))
    return fields.agg(F.count("*").alias("n"), F.count(F.when(valid, 1)).alias("valid"), share(valid, F.lit(True)).alias("overall_pct"), share(valid & critical, critical).alias("critical_pct"))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, w, h), 0 where they don't meet."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w < 0) | (h < 0), 0.0).otherwise(w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h))


def reading_order(x: Column, y: Column, band: int = 50) -> list[Column]:
    """Sort keys of boxes: rows of ``band`` pixels, then left to right."""
    return [F.floor(y / band).asc(), x.asc()]


def text_box(before: Column, page: Column, value: Column) -> Column:
    """Approximate box of a value on its page by line and column, from the page's text before it."""
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    lines = breaks(page) + 1
    clip = lambda c, a, b: F.least(F.lit(b), F.greatest(F.lit(a), c))
    x, y = clip(F.length(F.substring_index(before, "\n", -1)) / 100.0, 0.02, 0.92), clip(breaks(before) / lines, 0.02, 0.96)
    w = F.least(0.90 - x, clip(F.length(F.trim(value)) / 95.0, 0.08, 0.70))
    return F.struct(F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(F.greatest(F.lit(0.04), w), 4).alias("w"), F.round(clip(1.6 / lines, 0.018, 0.08), 4).alias("h"))


def rule_rows(rows: DataFrame, words: str, columns: list[str], status: Column, facet: str) -> DataFrame:
    """Rows whose columns, joined by spaces, hold the words, and whose status is the facet's; pass includes MANUAL_PASS."""
    wanted = status.isin("PASS", "MANUAL_PASS") if facet == "pass" else F.lower(status) == facet
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(words.lower())) & wanted)
