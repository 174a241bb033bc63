"""Values beside or below their labels, from the boxes of a page's words.

Words are rows (doc_id, page, text, x, y, w, h) in shares of the page. A label is a run of tokens in reading order; its value
is what stands right of it in its row, else the first row below it in its column. Labels are found with window functions
inside a page and meet the page's words in one equi-join, so a page is the unit and no document is gathered.

Null texts are empty, null coordinates 0; words without a document or page stand by no label. Among words of one corner the order is that of text, width and height; rows that
are equal throughout count as that many words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.text import let
from docgauge.plans.fields import is_label

# fixed values: the labels of each field, in order, and the pages it may stand on
LABELS_OF = {
    "county": ["County"],
    "owner_of_public_record": ["Owner of Public Record", "Owner of Record"],
    "legal_description": ["Legal Description"],
    "assessors_parcel_number": ["Assessor's Parcel #", "Assessor's Parcel Number", "APN"],
    "tax_year": ["Tax Year"],
    "neighborhood_name": ["Neighborhood Name"],
    "map_reference": ["Map Reference"],
    "census_tract": ["Census Tract"],
    "lender_name": ["Lender/Client", "Lender"],
    "lender_address": ["Lender Address", "Client Address"],
}
LAST_PAGE = {"lender_name": 2, "lender_address": 2}
# fixed values: shapes of the values that have one
SHAPES = {
    "county": r"^[A-Za-z][A-Za-z .'-]{1,40}$",
    "tax_year": r"^(?:19|20)\d{2}$",
    "real_estate_taxes": r"^\$?[\d,]+(?:\.\d{2})?$",
    "census_tract": r"^\d{1,6}(?:\.\d{1,4})?$",
    "map_reference": r"^[A-Za-z0-9][A-Za-z0-9 .#/-]{0,40}$",
    "assessors_parcel_number": r"^[A-Za-z0-9][A-Za-z0-9 .#/-]{1,60}$",
    "lender_name": r"^[A-Za-z0-9][A-Za-z0-9 &,.'/-]{2,80}$",
    "lender_address": r"^\d{1,6}\s+[A-Za-z0-9][A-Za-z0-9 #,.'/-]{6,120}$",
}
NOT_AN_ADDRESS = r"(?i)\b(?:currently offered|prior to|effective date|subject property|appraisal\?)\b"
MARKS = ["x", "X", "><", "✓", "✔", "[X]", "[x]"]
LONGEST = 140


def valid(name: Column, value: Column) -> Column:
    """Whether a value found by place fits its field: no label, 140 characters at most, of the field's shape."""
    shape = F.lit(True)
    for n, p in SHAPES.items():
        shape = F.when(name == n, value.rlike("(?i)" + p)).otherwise(shape)
    address = (name == "lender_address") & value.rlike(NOT_AN_ADDRESS)
    return F.coalesce((value != "") & ~is_label(value) & (F.length(value) <= LONGEST) & shape & ~address, F.lit(False))


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def _split(label: str) -> list[str]:
    return "".join(s if s.isascii() and s.isalnum() else " " for s in label.lower()).split()


def placed(words: DataFrame) -> DataFrame:
    """Words without nulls, numbered in reading order inside their page (``n``), with their middle height (``mid``)."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    # dealt by page before all else, so that words dealt by document alone are not shuffled once more for each side of a join
    plain = words.repartition("doc_id", "page").select("doc_id", "page", F.trim(F.coalesce("text", F.lit(""))).alias("text"), *[zero(c) for c in "xywh"])
    order = Window.partitionBy("doc_id", "page").orderBy("y", "x", "text", "w", "h")
    return plain.withColumn("n", F.row_number().over(order)).withColumn("mid", F.col("y") + F.col("h") / 2)


def labels(page_words: DataFrame, names: dict[str, list[str]], last_page: dict[str, int]) -> DataFrame:
    """Every place of every label: field_name, choice (which of its labels), label, at (place), x, y, w, h (its box)."""
    flat = [(name, i, label, _split(label)) for name, own in names.items() for i, label in enumerate(own)]
    longest = max(len(t) for *_, t in flat)
    # outer explodes: plain ones would test their arrays' sizes, and work them out, once more
    tokens = page_words.select("doc_id", "page", "n", F.struct("n", "x", "y", "w", "h").alias("word"), F.posexplode_outer(_tokens(F.col("text"))).alias("pos", "token")).where("token is not null")
    order = Window.partitionBy("doc_id", "page").orderBy("n", "pos")
    run = F.array(*[F.lead(F.struct("token", "word"), j).over(order) for j in range(longest)])
    runs = tokens.withColumn("run", run).withColumn("at", F.row_number().over(order)).where(F.col("token").isin(sorted({want[0] for *_, want in flat})))
    here = []
    for name, i, label, want in flat:
        same = F.lit(True)
        for j, t in enumerate(want):
            same &= F.coalesce(F.get("run", F.lit(j))["token"] == t, F.lit(False))
        if name in last_page:
            same &= F.col("page") <= last_page[name]
        here.append(F.when(F.coalesce(same, F.lit(False)), F.struct(F.lit(name).alias("field_name"), F.lit(i).alias("choice"), F.lit(label).alias("label"), F.lit(len(want)).alias("size"))))
    hits = runs.select("doc_id", "page", "at", "run", F.array(*here).alias("here")).select("doc_id", "page", "at", "run", F.explode_outer("here").alias("h")).where("h is not null")
    part = F.transform(F.slice("run", F.lit(1), F.col("h.size")), lambda r: r["word"])
    of = lambda f: F.transform(part, f)
    left, top = F.array_min(of(lambda b: b["x"])), F.array_min(of(lambda b: b["y"]))
    level = F.array_max(of(lambda b: b["y"])) - top <= 0.02
    box = [left.alias("x"), top.alias("y"), (F.array_max(of(lambda b: b["x"] + b["w"])) - left).alias("w"), (F.array_max(of(lambda b: b["y"] + b["h"])) - top).alias("h")]
    return hits.where(level).select("doc_id", "page", "at", "h.field_name", "h.choice", "h.label", *box)


def _value_line(words: Column) -> Column:
    """Words from left to right: leading labels left out, cut at the next label, without empty ones."""
    cell = "array<struct<x:double,n:int,text:string,y:double,w:double,h:double>>"
    start = F.struct(F.array().cast(cell).alias("kept"), F.lit(False).alias("done"))

    def step(s: Column, b: Column) -> Column:
        begun = F.size(s["kept"]) > 0
        lab = is_label(b["text"])
        grown = F.concat(s["kept"], F.array(b))
        return F.when(s["done"] | (lab & ~begun), s).when(lab, F.struct(s["kept"].alias("kept"), F.lit(True).alias("done"))).otherwise(F.struct(grown.alias("kept"), F.lit(False).alias("done")))

    return F.aggregate(F.filter(words, lambda b: b["text"] != ""), start, step)["kept"]


def _text(words: Column) -> Column:
    joined = F.regexp_replace(F.array_join(F.transform(words, lambda b: b["text"]), " "), r"\s+", " ")
    return F.regexp_replace(joined, r"^[ :|-]+|[ :|-]+$", "")


def _first_row(words: Column) -> Column:
    """The topmost row of words (mid, x, n, ...): while the next one's middle is within 0.014 of the row's running middle."""
    cell = "array<struct<x:double,n:int,text:string,y:double,w:double,h:double>>"
    start = F.struct(F.array().cast(cell).alias("kept"), F.lit(None).cast("double").alias("mid"), F.lit(False).alias("done"))

    def step(s: Column, b: Column) -> Column:
        plain = F.struct(b["x"].alias("x"), b["n"].alias("n"), b["text"].alias("text"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))
        near = ~s["done"] & (s["mid"].isNull() | (F.abs(s["mid"] - b["mid"]) <= 0.014))
        mid = F.when(s["mid"].isNull(), b["mid"]).otherwise((s["mid"] + b["mid"]) / 2)
        return F.when(near, F.struct(F.concat(s["kept"], F.array(plain)).alias("kept"), mid.alias("mid"), F.lit(False).alias("done"))).otherwise(F.struct(s["kept"].alias("kept"), s["mid"].alias("mid"), F.lit(True).alias("done")))

    # equal left edges keep the order of their middles
    row = F.aggregate(F.array_sort(words), start, step)["kept"]
    return F.array_sort(row, lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))


def near_labels(words: DataFrame, names: dict[str, list[str]] = LABELS_OF, last_page: dict[str, int] = LAST_PAGE, correct: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per document and field whose value stands near one of its labels.

    The first valid value wins by page, then by the order of the field's labels, then by reading order. Columns: doc_id,
    field_name, value, raw_value, confidence (0.82, 0.77 if ``correct`` changed the value), page, x, y, w, h (the value's
    box), method.
    """
    base = placed(words)
    marks = labels(base, names, last_page).select("doc_id", "page", "at", "field_name", "choice", *[F.col(c).alias("l" + c) for c in "xywh"])
    # merged, never broadcast: Spark's size estimates don't count what explodes add, so labels of millions of pages look small
    both = marks.hint("merge").join(base, ["doc_id", "page"])
    x, y, mid = F.col("x"), F.col("y"), F.col("mid")
    right, bottom, level = F.col("lx") + F.col("lw"), F.col("ly") + F.col("lh"), F.col("ly") + F.col("lh") / 2
    beside = (x >= right + 0.005) & (x <= F.least(F.lit(0.98), right + 0.42)) & (F.abs(mid - level) <= F.greatest(F.lit(0.014), F.col("lh") * 0.75))
    below = (x >= F.greatest(F.lit(0.0), F.col("lx") - 0.015)) & (y >= bottom + 0.003) & (y <= F.least(F.lit(0.98), bottom + 0.12))
    ends = (x > right) & (F.abs(mid - level) <= 0.018)
    b = F.struct("x", "n", "text", "y", "w", "h")
    lower = F.struct("mid", "x", "n", "text", "y", "w", "h")
    key = ["doc_id", "page", "at", "field_name", "choice", "lx", "ly", "lw", "lh"]
    met = both.where(beside | below | ends).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(beside, b))).alias("beside"), F.collect_list(F.when(below, lower)).alias("below"), F.min(F.when(ends & is_label(F.col("text")), x)).alias("next_x")
    )
    bound = F.coalesce(F.col("next_x") - 0.006, F.least(F.lit(0.98), F.col("lx") + F.greatest(F.col("lw") + 0.04, F.lit(0.20))))
    in_row = let(_value_line(F.col("beside")), lambda a: F.when((F.size(a) > 0) & ~is_label(_text(a)), a))
    in_column = _value_line(_first_row(F.filter("below", lambda c: c["x"] <= bound)))
    judged = lambda v: let(_text(v), lambda raw: F.when(valid(F.col("field_name"), raw), F.struct(raw.alias("raw_value"), F.col("page"), v.alias("v"))))
    found = met.select("doc_id", "page", "at", "field_name", "choice", let(F.coalesce(in_row, in_column), judged).alias("c"))
    # places without a valid value are passed over by their null order; a filter would work the values out once more
    best = found.groupBy("doc_id", "field_name").agg(F.min_by("c", F.when(F.col("c").isNotNull(), F.struct("page", "choice", "at"))).alias("b")).where("b is not null")
    raw, v = F.col("b.raw_value"), F.col("b.v")
    value = correct(raw) if correct else raw
    left, top = F.array_min(v["x"]), F.array_min(v["y"])
    wide, high = (F.array_max(F.transform(v, lambda c: c[a] + c[s])) for a, s in (("x", "w"), ("y", "h")))
    return best.select(
        "doc_id", "field_name", value.alias("value"), raw.alias("raw_value"), F.when(value == raw, 0.82).otherwise(0.77).alias("confidence"), F.col("b.page").alias("page"),
        left.alias("x"), top.alias("y"), (wide - left).alias("w"), (high - top).alias("h"), F.lit("word_box_anchor").alias("method"),
    )


def marked_choice(words: DataFrame, choices: dict[str, list[str]]) -> DataFrame:
    """The option of each group that has a mark up to 0.08 left of its label, in its row: (doc_id, field_name, value, confidence, page).

    Of a page's places of a label only the first counts; the first page, then the first option wins.
    """
    base = placed(words)
    places = labels(base, choices, {})
    first = places.groupBy("doc_id", "page", "field_name", "choice", "label").agg(F.min_by(F.struct("x", "y", "h"), "at").alias("l"))
    marks = base.where(F.col("text").isin(MARKS)).select("doc_id", "page", F.col("x").alias("mx"), "mid")
    x, y, h = F.col("l.x"), F.col("l.y"), F.col("l.h")
    near = (x > F.col("mx")) & (x - F.col("mx") <= 0.08) & (F.abs(F.col("mid") - (y + h / 2)) <= F.greatest(F.lit(0.018), h * 1.2))
    hit = first.hint("merge").join(marks, ["doc_id", "page"]).where(near)  # as in near_labels
    best = hit.groupBy("doc_id", "field_name").agg(F.min_by(F.struct("label", "page"), F.struct("page", "choice")).alias("b"))
    return best.select("doc_id", "field_name", F.col("b.label").alias("value"), F.lit(0.86).alias("confidence"), F.col("b.page").alias("page"))


def with_spatial(found: DataFrame, by_place: DataFrame) -> DataFrame:
    """Fields read from text, and by place those that text did not give (same columns: doc_id, field_name, value, confidence, page, method)."""
    columns = ["doc_id", "field_name", "value", "confidence", "page", "method"]
    lacking = by_place.join(found.select("doc_id", "field_name").distinct(), ["doc_id", "field_name"], "left_anti")
    return found.select(*columns).unionByName(lacking.select(*columns))
