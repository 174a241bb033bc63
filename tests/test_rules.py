"""The rule catalogue: outcomes, configuration, applicability, cross-field findings, and the other column functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from docgauge.functions import commentary, dates, numeric
from docgauge.functions import text as T
from docgauge.operators import matching, ordered
from docgauge.plans import rules

DOC = """doc_id string, raw_text string, loan_type string, assignment_type string, vision_condition string,
 subject struct<address:string,city:string,state:string,zip_code:string,borrower:string,owner_of_public_record:string,legal_description:string,apn:string,tax_year:string,real_estate_taxes:double,hoa_dues:double,is_pud:boolean,hoa_period:string,occupant_status:string,special_assessments:double>,
 letter struct<property_address:string,city:string,state:string,zip_code:string,borrower_name:string>, contract struct<contract_price:double,did_analyze_contract:boolean>,
 neighborhood struct<price_low:double,price_high:double,property_values:string,description:string,market_conditions:string>, improvements struct<condition_rating:string,effective_age:int,year_built:int>,
 sales struct<comparables:array<struct<address:string,sale_price:double,condition_rating:string,gla:double,room_count_total:int,room_count_bed:int,room_count_bath:double>>>"""


def doc(**given):
    base = {"doc_id": "d", "raw_text": "", "loan_type": "Conventional", "assignment_type": "Refinance", "vision_condition": None, "subject": {}, "letter": {}, "contract": {}, "neighborhood": {}, "improvements": {}, "sales": {"comparables": []}}
    return base | given


def status(spark, **given):
    return {r.rule_id: (r.status, r.note) for r in rules.evaluate(spark.createDataFrame([doc(**given)], DOC), 2024).collect()}


@pytest.fixture(scope="module")
def blank(spark):
    return status(spark)


def test_every_rule_ends_in_a_status(blank):
    assert len(rules.REGISTRY) == 136 and len(blank) == 136
    assert {s for s, _ in blank.values()} <= {"PASS", "VERIFY", "FAIL"}


def test_missing_data_asks_for_a_look(blank):
    assert blank["S-1"][0] == blank["S-2"][0] == blank["S-4"][0] == blank["S-8"][0] == "VERIFY"
    assert blank["S-3"][0] == blank["S-5"][0] == "FAIL"
    assert blank["SCA-17"] == ("PASS", None)  # no comparable lacks a count
    assert blank["C-1"] == ("PASS", "not applicable") and blank["FHA-2"] == ("PASS", "not applicable")


def test_good_bad_and_doubtful(spark):
    same = {"address": "12 Oak Street", "city": "Austin", "state": "TX", "zip_code": "78701", "borrower": "Jane Doe", "owner_of_public_record": "Jane Doe", "legal_description": "Lot 1", "apn": "1", "tax_year": "2023", "real_estate_taxes": 4000.0, "hoa_dues": 0.0, "is_pud": False, "occupant_status": "Tenant", "special_assessments": 0.0}
    letter = {"property_address": "12 OAK STREET", "city": "austin", "state": "TX", "zip_code": "78701", "borrower_name": "JANE DOE"}
    comps = [{"address": "1 A St", "sale_price": 300.0, "condition_rating": "C3", "gla": 1.0, "room_count_total": 5, "room_count_bed": 3, "room_count_bath": 1.0}]
    got = status(spark, subject=same, letter=letter, sales={"comparables": comps}, neighborhood={"price_low": 100.0, "price_high": 200.0, "property_values": "Increasing"}, improvements={"condition_rating": "C1", "effective_age": 9, "year_built": 1990})
    assert [got[i][0] for i in ("S-1", "S-2", "S-3", "S-4", "S-7", "S-8", "SCA-16", "SCA-17", "N-3")] == ["PASS", "PASS", "PASS", "PASS", "VERIFY", "PASS", "PASS", "PASS", "PASS"]
    assert got["XF-1"][0] == "FAIL" and got["XF-2"][0] == "VERIFY" and got["XF-3"][0] == "VERIFY" and "XF-4" not in got and "XF-5" not in got
    got = status(spark, assignment_type="Purchase", loan_type="FHA", subject=same | {"borrower": "Other", "tax_year": "2019", "hoa_dues": 10.0}, letter=letter, contract={"did_analyze_contract": False}, sales={"comparables": [comps[0] | {"gla": None, "condition_rating": "bad"}]})
    assert [got[i][0] for i in ("S-2", "S-4", "S-9", "C-1", "FHA-2", "SCA-16", "SCA-17", "XF-5", "XF-FHA-1")] == ["FAIL", "FAIL", "FAIL", "FAIL", "FAIL", "FAIL", "VERIFY", "FAIL", "FAIL"]


def test_overrides_and_registration(spark):
    off = spark.createDataFrame([("S-3", False, None), ("S-5", None, "ADVISORY")], "rule_id string, is_active boolean, severity_level string")
    settings = rules.configured(rules.config(spark), off)
    out = {r.rule_id: r for r in rules.evaluate(spark.createDataFrame([doc()], DOC), 2024, settings).collect()}
    assert (out["S-3"].status, out["S-3"].note, out["S-5"].severity, out["S-5"].status) == ("PASS", "disabled", "ADVISORY", "FAIL")
    assert rules.evaluate(spark.createDataFrame([], DOC), 2024).count() == 0


def test_roundings_differ(spark):
    df = spark.createDataFrame([(0.25,), (-0.25,), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.round_half_up_floor(F.col("x"))).collect()] == [0.3, -0.2, None]
    assert [r[0] for r in df.select(numeric.round_half_even(F.col("x"), 1)).collect()] == [0.2, -0.2, None]
    o = spark.createDataFrame([(1.0, 0.98), (1.0, 0.979), (0.7, 1.0), (0.69, 1.0), (2.0, 2.0)], "m double, c double")
    assert [r[0] for r in o.select(numeric.outcome(F.col("m"), F.col("c"))).collect()] == ["PASS", "VERIFY", "VERIFY", "FAIL", "PASS"]


def test_dates_and_pivots(spark):
    df = spark.createDataFrame([("2024-3-1",), ("3/1/2024",), ("03-01-2024",), ("March 1, 2024",), ("3/1/69",), ("3/1/70",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(dates.parse_date(F.col("t"))).collect()] == [date(2024, 3, 1)] * 4 + [date(2069, 3, 1), date(1970, 3, 1), None, None]


def test_file_keys_and_scores(spark):
    df = spark.createDataFrame([("123_9 Oak Street_77.pdf",), ("name_.pdf",), ("  ",), (None,)], "f string")
    assert [r[0] for r in df.select(T.order_id(F.col("f"))).collect()] == ["77", "name_", None, None]
    files = spark.createDataFrame(
        [(1, 1, "APPRAISAL", "9 Oak 1.pdf", "77"), (2, 1, "ENGAGEMENT", "x.pdf", "77"), (3, 1, "ENGAGEMENT", "y.pdf", "77"), (4, 1, "APPRAISAL", "12 elm house.pdf", None), (5, 1, "CONTRACT", "house 12.pdf", None), (6, 1, "CONTRACT", "._12 elm house.pdf", None), (7, 2, "APPRAISAL", "lone.pdf", "8")],
        "id long, batch_id long, file_type string, filename string, order_id string")
    got = {r.id: (r.letter_id, r.contract_id) for r in matching.triples(files).collect()}
    assert got[1][0] == 2 and got[4][1] == 5 and got[7] == (None, None)


def test_commentary(spark):
    df = spark.createDataFrame([(None,), ("no adverse conditions were noted, this is a stable neighborhood",), ("prices rose 5% by 1/2/2023 because 12 sales closed near the school",)], "t string")
    got = [tuple(r.c) for r in df.select(commentary.canned(F.col("t"), rules.CANNED, rules.SPECIFIC, rules.REASONS).alias("c")).collect()]
    assert got == [(True, 0.9), (True, 0.75), (False, 0.8)]


def test_pages_rows_and_labels(spark):
    pages = spark.createDataFrame([("d", 1, "abc"), ("d", 2, "de"), ("e", 1, "x")], "doc string, page int, text string")
    starts = ordered.page_starts(pages, "doc", "page", "text")
    assert sorted((r.doc, r.page, r.start) for r in starts.collect()) == [("d", 1, 0), ("d", 2, 5), ("e", 1, 0)]
    asks = spark.createDataFrame([("d", 0), ("d", 4), ("d", 5), ("d", 99)], "doc string, pos long")
    assert sorted((r.pos, r.page) for r in ordered.page_of(asks, starts, "doc", "pos", "page").collect()) == [(0, 1), (4, 1), (5, 2), (99, 2)]
    words = [("d", 1, t, x, y, 0.05, 0.01) for t, x, y in (("Neighborhood", 0.1, 0.1), ("Name", 0.2, 0.1), ("Sagecreek", 0.1, 0.15), ("far", 0.1, 0.9))]
    df = spark.createDataFrame(words, "doc string, page int, text string, bbox_x double, bbox_y double, bbox_w double, bbox_h double")
    got = ordered.spatial_value(df, ["doc", "page"], ["Neighborhood", "Name"]).collect()
    assert [(r.value, r.bbox_x, r.bbox_y) for r in got] == [("Sagecreek", 0.1, 0.15)]
    assert sorted(r.line for r in ordered.row_clusters(df, ["doc", "page"], "bbox_y", "bbox_h").collect()) == [0, 0, 1, 2]


def test_documents_of_one_row_group_are_dealt_to_all_cores(spark):
    from docgauge.plans import rule_queries

    plan = rule_queries.rule_engine_all(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [doc_id" in plan


def test_text_search_by_literals_equals_the_patterns(spark):
    """Literals first give what the pattern alone gives, also for signs whose lower case is a letter of ASCII."""
    texts = ["", "FEE  SIMPLE", "fee simple", "Fee\nSimple", "roof deck", "a Decks", "Kitchen Subject Bath", "KİTCHEN", "kitchen", "bathrooms bathroom", "drive by", "DRIVE-BY", "comp 3", "compa 3", "E&o", "interiors Interior",
             "opinion of value: $350,000", "opinion of value", "FHA Case Number x 123-1234567", "fha case\n123-1234567", "q3", "Q3", "0SF", "form216", "12 X 14", "trainees", "MLS 7 a DOM 30", "dom30", "comparable\nmap", "Signature of Appraiser"]
    patterns = [p for *_, ps in rules.TEXT_RULES for p in ps] + [r[5] for r in rules.COMPARABLE_RULES] + ["a(b|c)|d", "(?:ab|cd)e|(f)|g", "x*|y", r"[|]a|\|b"]
    rows = spark.createDataFrame([(t,) for t in texts + patterns], "raw_text string")
    d = rules.Doc(rows.schema, 2024)
    got = rows.select("raw_text", *[F.struct(d.has(p), F.col("raw_text").rlike("(?i)" + p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    assert not [(r[0], patterns[i - 1]) for r in got for i in range(1, len(r)) if r[i][0] != r[i][1]]


def test_rules_are_worked_out_once_and_compiled(spark):
    plan = rules.evaluate(spark.createDataFrame([doc()], DOC), 2024)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if ("Generate" in line or "Filter" in line) and ("RLIKE" in line or "array(" in line)]
