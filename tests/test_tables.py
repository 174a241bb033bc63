"""Table pairs, page search, and the address, tract, area and name normalisers."""

import time

from pyspark.sql import functions as F

from docgauge.functions import documents as D
from docgauge.functions import text as T
from docgauge.operators import ordered, relational, tables
from docgauge.plans import rules
from docgauge.sources import tables as sources

from test_rules import DOC, doc


def test_pairs(spark):
    rows = [
        ("d", 1, ["Borrower:", "Jane Doe", None]), ("d", 2, ["County", "City"]), ("d", 3, ["Travis", " Austin |"]), ("d", 4, ["Lender/Client Big Bank Address 1 Main St"]),
        ("d", 5, ["borrower", "JANE DOE"]), ("d", 6, ["", None]), ("e", 1, None), ("f", 1, []),
    ]
    df = spark.createDataFrame(rows, "doc string, row int, cells array<string>")
    got = [(r.doc, r.label, r.value) for r in tables.label_values(df, ["doc"]).collect()]
    assert got == [("d", "Borrower", "Jane Doe"), ("d", "County", "Travis"), ("d", "City", "Austin"), ("d", "Lender/Client", "Big Bank"), ("d", "Lender Address", "1 Main St")]


def test_pages(spark):
    pages = spark.createDataFrame([("d", 1, "Site and View"), ("d", 2, "site"), ("d", 3, None), ("e", 2, "view view")], "doc_id string, page int, text string")
    assert [(r.doc_id, r.page, r.score) for r in tables.pages_with(pages, "doc_id", "page", "text", ["SITE", "view"], 1).orderBy("doc_id").collect()] == [("d", 1, 2), ("e", 2, 1)]
    assert [r.page for r in tables.pages_with(pages, "doc_id", "page", "text", ["site", "view"], 9, need_all=True).collect()] == [1]
    assert [(r.page, r.score) for r in tables.pages_matching(pages, "doc_id", "page", "text", "view").orderBy("doc_id").collect()] == [(1, 1), (2, 2)]
    expected = spark.createDataFrame([("d", 4), ("e", 2), ("f", 0), ("g", 1)], "doc_id string, page_count int")
    assert {r.doc_id: r.missing for r in tables.missing_pages(pages, expected).collect()} == {"d": [4], "e": [1], "g": [1]}


def test_normalisers(spark):
    df = spark.createDataFrame([("12 North Oak Street", "12 Oak St. N"), ("12 Elm Ct", "12 Oak Ct"), (None, "x"), ("", "")], "a string, b string")
    got = [tuple(r) for r in df.select(F.array_join(T.street_tokens(F.col("a")), " "), T.same_street(T.street_tokens(F.col("a")), T.street_tokens(F.col("b")))).collect()]
    assert got == [("12 OAK ST N", True), ("12 ELM CT", False), (None, False), ("", False)]
    one = spark.createDataFrame([("0012.03", "1.5 acres", "APN (report)"), ("12 3456 7", "7,500 sf", "Client (engagement letter)"), ("12", "none", "Zip"), (None, None, None)], "t string, a string, n string")
    assert [tuple(r) for r in one.select(T.census_tract(F.col("t")), T.area_square_feet(F.col("a")), T.field_name(F.col("n"))).collect()] == [
        ("0012.03", 65340.0, "assessors_parcel_number"), ("1234.56", 7500.0, "client"), ("12", 0.0, "zip_code"), (None, 0.0, None)]


def test_addresses_and_fha_dates(spark):
    place = {"city": "Austin", "state": "TX", "zip_code": "78701", "county": "Travis"}
    base = doc(
        loan_type="FHA", raw_text="Effective date 1/1/2024", subject={"address": "12 Oak Street North", **place}, letter={"property_address": "12 N Oak St Property County Travis", **place, "zip_code": "78701-1234"}, sales={"comparables": [{"sale_date": "12/1/2022"}]}
    )
    schema = DOC.replace("gla:double", "gla:double,sale_date:string") + ", pages array<string>"
    got = {r.rule_id: r.status for r in rules.evaluate(spark.createDataFrame([base | {"pages": ["case 123-4567890", "none here"]}], schema), 2024).collect()}
    assert got["S-1"] == "PASS" and got["XF-FHA-1"] == "FAIL" and got["XF-FHA-2"] == "FAIL"
    nowhere = base | {"pages": None, "subject": {"address": "12 Oak Street North"}}
    assert {r.rule_id: r.status for r in rules.evaluate(spark.createDataFrame([nowhere], schema), 2024, rules=["S-1"]).collect()}["S-1"] == "FAIL"
    good = base | {"pages": ["case 123-4567890"], "sales": {"comparables": [{"sale_date": "2/1/2023"}]}}
    got = {r.rule_id for r in rules.evaluate(spark.createDataFrame([good], schema), 2024).collect()}
    assert not {"XF-FHA-1", "XF-FHA-2"} & got


def test_pages_documents_and_answers(spark):
    df = spark.createDataFrame([("short", ""), ("the property address and borrower value " + "x" * 20, "{bad"), ("§" * 40, "so: {\"a\": 1} ok"), (None, None)], "t string, r string")
    assert [round(r[0], 4) for r in df.select(D.page_confidence(F.col("t"))).collect()] == [0.1, 0.7, 0.3, 0.1]
    got = [(r.j.answer and r.j.answer.a, r.j.error) for r in df.select(D.answer_json(F.col("r"), "a int").alias("j")).collect()]
    assert got == [(None, "no_response"), (None, "unparseable"), (1, None), (None, "no_response")]
    assert [r[0] for r in df.select(D.answer_confidence(F.col("r"))).distinct().collect()] == [0.6]
    two = spark.createDataFrame([("Form 1073 in San Marcos, TX.", "san marcos"), ("URAR", None), (None, "x")], "a string, b string")
    assert [tuple(r) for r in two.select(D.form_type(F.col("a")), D.mismatched_tokens(F.col("a"), F.col("b"))).collect()] == [("1073", ["form", "1073", "in", "tx."]), ("1004", ["urar"]), (None, [])]
    assert [round(r[0], 2) for r in two.select(D.document_confidence([F.col("a")], [F.col("b")], F.col("a"))).collect()] == [0.45, 0.4, 0.35]
    assert [r[0] for r in two.select(D.excerpt(F.col("a"), ["marcos", "none"], 9, 4, 6)).collect()] == ["San Marco", "URAR", None]


def test_marks_nested_rows_and_reports(spark, tmp_path):
    words = [("d", t, x, y, 0.02, 0.01) for t, x, y in (("X", 0.10, 0.5), ("Owner", 0.14, 0.5), ("Tenant", 0.3, 0.5), ("x", 0.6, 0.7), ("Tenant", 0.9, 0.7))]
    df = spark.createDataFrame(words, "doc string, text string, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
    assert [tuple(r) for r in ordered.marked_labels(df, ["doc"], [["Tenant"], ["Owner"]]).collect()] == [("d", "Owner")]
    p, c = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "b", None), (1, "a", True)], "pid long, n string, open boolean")
    assert {r.id: [x.n for x in r.kids] for r in relational.nested(p, c, "id", "pid", ["n"], "kids").collect()} == {1: ["a", "b"], 2: []}
    assert {tuple(r) for r in relational.pending(c, "n", F.col("open")).collect()} == {("a", True), ("b", False)}
    long = sources.fields_long(spark.createDataFrame([(1, "x", None, 2.0)], "id long, a string, b string, c double"), "id", ["a", "b", "c"])
    assert {tuple(r) for r in long.collect()} == {(1, "a", "x"), (1, "c", "2.0")}
    sources.write_report(p.withColumn("n", F.lit(None).cast("string")), f"{tmp_path}/r")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/r").collect()) == ['{"id":1,"n":null}', '{"id":2,"n":null}']
    assert [r[0] for r in spark.createDataFrame([("aab",), (None,)], "t string").select(T.replaced(F.col("t"), {"a": "b", "bbb": "c"})).collect()] == ["c", None]


def test_span_of_a_long_text_takes_linear_time(spark):
    from docgauge.operators import evidence

    words = ["the", "and"] * 30000 + ["the", None, "The", "End"]
    df = spark.createDataFrame([(1, words, "THE  end"), (2, words, "end the"), (3, words, "absent end"), (4, words, " "), (5, None, "the"), (6, ["a"], None)], "id int, ws array<string>, v string")
    start = time.monotonic()
    got = {r.id: r.s and tuple(r.s) for r in df.select("id", evidence.word_span(F.col("ws"), F.col("v")).alias("s")).collect()}
    assert got == {1: (60003, 60004), 2: (60004, 60004), 3: None, 4: None, 5: None, 6: None}
    assert time.monotonic() - start < 60
