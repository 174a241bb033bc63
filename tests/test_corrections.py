"""Corrections of misread labels, states and digits, against a plain loop."""

import re

from pyspark.sql import functions as F

from docgauge.functions import corrections as C
from docgauge.plans import fields

TEXTS = ["Borr0wer: Jane", "Price $l00,O00 and 1O0O0 or Ol", "Austin, T X", "Map Ref 12", "Map Reference", "[X] Owner X] ]X[ ><", "0 wner 0wner", "clean", "", None, "$O5 5O 5O5O5 lll 1l1l1", "Assessors Parcel"]


def loop(text):
    for table in (C.LABEL_CORRECTIONS, C.STATE_FIXES):
        for wrong, right in table.items():
            text = text.replace(wrong, right)
    text = re.sub(r"(?<=\d)O(?=\d)|(?<=\$)O(?=\d)", "0", text)
    return re.sub(r"(?<=\$)l(?=\d)|(?<=\d)l(?=\d)", "1", text)


def test_corrections_equal_a_loop(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    learned = [("clean", "neat"), ("neat", "tidy"), ("absent", "x")]
    got = {r.i: r for r in df.select("i", C.corrected(F.col("t")).alias("one"), C.corrected_document(F.col("t"), learned).alias("all")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].one == (None if t is None else loop(t))
        if t is None:
            assert tuple(got[i]["all"]) == (None, 0)
        else:
            assert got[i]["all"].text == loop(t).replace("clean", "neat").replace("neat", "tidy")
            assert got[i]["all"].corrections == sum(w in t for w in C.LABEL_CORRECTIONS) + 2 * (t == "clean")


def test_a_corrected_value_is_less_sure(spark):
    df = spark.createDataFrame([("A: 1O0 net",), ("A: 100",), ("B: Counly",), ("A: Borrower\nB: x",), ("A: net",), (None,)], "t string")
    f = fields.field(F.col("t"), [r"A:\s*([^\n]+)", r"B:\s*([^\n]+)"], r"\s*net$", C.corrected)
    assert [tuple(r.f) for r in df.select(f.alias("f")).collect()] == [
        ("100", 0.83, "spatial_anchor", "1O0", True), ("100", 0.88, "spatial_anchor", "100", False), ("County", 0.73, "regex_fallback", "Counly", True), ("x", 0.78, "regex_fallback", "x", False),
        (None, 0.0, "not_found", None, False), (None, 0.0, "not_found", None, False)]
    assert fields.field(F.col("t"), [f"(z{i})" for i in range(9)]) is not None
