"""Word boxes against a plain loop over each page, readings of older layouts, and reports against letters at the edges."""

import random
import re

import duckdb

from docgauge.functions import commentary, legacy
from docgauge.plans import catalog, comparison, reading_queries, reports, spatial
from docgauge.plans.fields import LABELS
from pyspark.sql import functions as F

WORDS = "doc_id long, page int, text string, x double, y double, w double, h double"


def label(v):
    low = v.lower()
    return low in LABELS or re.sub(r"[:.#\s]+$", "", low) in LABELS


def line_of(row):
    out = []
    for b in row:
        if not b["text"] or (label(b["text"]) and not out):
            continue
        if label(b["text"]):
            break
        out.append(b)
    return out


def text_of(row):
    return re.sub(r"\s+", " ", " ".join(b["text"] for b in row)).strip(" :-|")


def loop(rows):
    """The plain way: every page, every label, every place, one after the other."""
    out = {}
    for page in sorted({r["page"] for r in rows}):
        words = sorted((r for r in rows if r["page"] == page), key=lambda r: (r["y"], r["x"], r["text"], r["w"], r["h"]))
        flat = [(t, i) for i, r in enumerate(words) for t in re.findall("[a-z0-9]+", r["text"].lower())]
        for name, labels in spatial.LABELS_OF.items():
            if name in out or page > spatial.LAST_PAGE.get(name, page):
                continue
            for want in (re.findall("[a-z0-9]+", x.lower()) for x in labels):
                for at in range(len(flat) - len(want) + 1):
                    if name in out or [t for t, _ in flat[at : at + len(want)]] != want:
                        continue
                    own = [words[i] for i in sorted({i for _, i in flat[at : at + len(want)]})]
                    if max(o["y"] for o in own) - min(o["y"] for o in own) > 0.02:
                        continue
                    lx, ly = min(o["x"] for o in own), min(o["y"] for o in own)
                    right, bottom = max(o["x"] + o["w"] for o in own), max(o["y"] + o["h"] for o in own)
                    right, bottom = lx + (right - lx), ly + (bottom - ly)
                    middle, mid = ly + (bottom - ly) / 2, lambda b: b["y"] + b["h"] / 2
                    beside = [b for b in words if right + 0.005 <= b["x"] <= min(0.98, right + 0.42) and abs(mid(b) - middle) <= max(0.014, (bottom - ly) * 0.75)]
                    beside = line_of(sorted(beside, key=lambda b: b["x"]))
                    if beside and not label(text_of(beside)):
                        value = text_of(beside)
                    else:
                        ends = [b["x"] for b in words if b["x"] > right and abs(mid(b) - middle) <= 0.018 and label(b["text"])]
                        bound = min(ends) - 0.006 if ends else min(0.98, lx + max(right - lx + 0.04, 0.20))
                        below = [b for b in words if max(0.0, lx - 0.015) <= b["x"] <= bound and bottom + 0.003 <= b["y"] <= min(0.98, bottom + 0.12)]
                        row, run = [], None
                        for b in sorted(below, key=lambda b: (mid(b), b["x"])):
                            if run is not None and abs(run - mid(b)) > 0.014:
                                break
                            run = mid(b) if run is None else (run + mid(b)) / 2
                            row.append(b)
                        value = text_of(line_of(sorted(row, key=lambda b: b["x"])))
                    shape = spatial.SHAPES.get(name)
                    bad = name == "lender_address" and re.search(spatial.NOT_AN_ADDRESS, value)
                    if value and not label(value) and len(value) <= 140 and not bad and (not shape or re.match(shape, value, re.I)):
                        out[name] = (value, page)
    return out


def test_word_boxes_against_a_plain_loop(spark):
    rng = random.Random(5)
    texts = ["County", "Tax", "Year", "Census", "Tract", "Map", "Reference", "Lender", "Client", "Lender/Client", "Address", "APN", "Legal", "Description", "Travis", "2023", "12.5", "A1", "First", "Bank", "12", "Main", "Street", "prior to", ":", "-", "", "City"]
    rows = []
    for doc in range(120):
        for page in (1, 2, 3):
            for _ in range(rng.randrange(4, 26)):
                rows.append((doc, page, rng.choice(texts), rng.randrange(2, 95) / 100, rng.randrange(10, 30) / 100, rng.randrange(2, 9) / 100, rng.choice([0.01, 0.02, 0.03])))
            rows.append((doc, page, "Tax", 0.05, 0.5, 0.03, 0.02))
            rows.append((doc, page, "Year", 0.09, 0.505, 0.04, 0.02))
            rows.append((doc, page, rng.choice(["2023", "1850", "Zip"]), 0.05 + rng.randrange(20) / 100, 0.5 + rng.randrange(14) / 100, 0.04, 0.02))
    names = [c.split()[0] for c in WORDS.split(", ")]
    got = {}
    for r in spatial.near_labels(spark.createDataFrame(rows, WORDS)).collect():
        got.setdefault(r["doc_id"], {})[r["field_name"]] = (r["value"], r["page"])
    want = {}
    for doc in range(120):
        found = loop([dict(zip(names, r, strict=True)) for r in rows if r[0] == doc])
        if found:
            want[doc] = found
    assert len(want) > 60 and len({n for d in want.values() for n in d}) > 5
    assert got == want


def test_word_boxes_at_the_edges(spark):
    empty = spark.createDataFrame([], WORDS)
    assert spatial.near_labels(empty).count() == 0 and spatial.marked_choice(empty, {"location": ["Urban"]}).count() == 0
    rows = [(1, 1, None, None, None, None, None), (1, 1, "County", 0.1, 0.1, 0.1, 0.02), (1, 1, "Hays", 0.25, 0.1, 0.1, 0.02), (1, 1, "Hays", 0.25, 0.1, 0.1, 0.02), (2, 1, "County", 0.1, 0.1, 0.1, 0.02)]
    got = spatial.near_labels(spark.createDataFrame(rows, WORDS), correct=lambda c: F.replace(c, F.lit("Hays Hays"), F.lit("Hays"))).collect()
    assert [(r["value"], r["raw_value"], r["confidence"], round(r["w"], 2)) for r in got] == [("Hays", "Hays Hays", 0.77, 0.1)]
    found = spark.createDataFrame([(1, "county", "Travis", 0.88, 3, "spatial_anchor")], "doc_id long, field_name string, value string, confidence double, page int, method string")
    both = spatial.with_spatial(found, spatial.near_labels(spark.createDataFrame([*rows, (2, 1, "Hays", 0.25, 0.1, 0.1, 0.02)], WORDS)))
    assert sorted((r["doc_id"], r["value"]) for r in both.collect()) == [(1, "Travis"), (2, "Hays")]


def test_difference_report_at_the_edges(spark):
    schema = "doc_id long, subject struct<address:string, property_rights:string, real_estate_taxes:double, neighborhood_name:string>, letter struct<property_address:string, contract_price:double, assignment_type:string>"
    rows = [(1, None, None), (2, None, (None, None, None)), (3, (" 1 A st", None, 1.0, "X"), ("1 A ST", 1e7, "Purchase")), (4, ("2", "Fee", 1.0, "X"), ("3", 0.0, "purchase"))]
    got = {}
    for r in comparison.difference_report(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r["doc_id"], []).append((r["position"], r["field_name"], r["status"], r["expected_value"]))
    assert 1 not in got and [x[:3] for x in got[2]] == [(0, "real_estate_taxes", "MISSING"), (1, "neighborhood_name", "MISSING")]
    assert got[3] == [(0, "assignment_type", "MISSING", "Purchase"), (1, "contract_price", "MISSING", "10000000.0")]
    assert got[4] == [(0, "property_address", "DIFFERENT", "3"), (1, "assignment_type", "MISSING", "purchase"), (2, "property_rights", "PRESENT", None)]


def test_older_readings_of_nulls_and_oddities(spark):
    texts = [(None,), ("",), ("Borrower:\n\n5\nZoning Compliance Legal Non-Conforming\nflood zone is marked X",), ("x" * 300_000 + " Area , sf",)]
    df = spark.createDataFrame(texts, "text string").coalesce(1)
    t = F.col("text")
    got = df.select(legacy.report_fields(t).alias("r"), legacy.site_fields(t).alias("s"), legacy.boxes(t).alias("b"), legacy.normalized_address(t).alias("a"), legacy.area(t).alias("f")).collect()
    assert [g["r"]["borrower_name"] for g in got] == [None, None, "", None]
    assert [g["s"]["zoning_compliance"] for g in got] == [None, None, "Legal Non-Conforming", None]
    assert [g["b"]["is_in_flood_zone"] for g in got] == [False, False, True, False]
    assert [g["a"]["confidence"] for g in got[:2]] == [0.0, 0.0] and got[0]["a"]["full_address"] == ""
    assert [(g["f"]["value"], g["f"]["unit"]) for g in got] == [(0.0, "sf"), (0.0, "sf"), (5.0, "sf"), (0.0, "sf")]
    rows = spark.createDataFrame([("5 Oak St, Charleston, West Virginia WV 25301",), ("1 A St, Reno, Nevada",), ("9 B Rd Suite 7, (Old) Reno, NV",)], "text string").select(legacy.normalized_address(t).alias("a")).collect()
    assert [(r["a"]["street"], r["a"]["city"], r["a"]["state"], r["a"]["unit"]) for r in rows][2] == ("9 B Rd Suite 7, (Old)", "Reno", "NV", "7")
    assert rows[0]["a"]["state"] == "WV" and rows[0]["a"]["zip_code"] == "25301" and rows[1]["a"]["state"] == "NV"


def test_commentary_analysis_of_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("prices increase because of 2024 sales and because of demand across the area",)], "text string")
    got = [r["a"] for r in df.select(commentary.analysis(F.col("text"), ["typical"], ["[0-9]{4}"], ["because"], {"up": ["increas"], "down": ["fall"]}).alias("a")).collect()]
    assert [(a["is_canned"], a["word_count"], a["has_reasoning"], a["market_trends"]) for a in got[:2]] == [(True, 0, False, {})] * 2
    assert got[2]["has_reasoning"] and got[2]["market_trends"] == {"up": ["increas"]} and got[2]["has_specific_details"] and got[2]["word_count"] == 13


def test_rules_rest_on_word_boxes_where_the_text_gives_nothing(spark):
    pages = spark.createDataFrame([(1, "report", 1, "Legal Description Lot 1"), (2, "report", 1, "Census Tract 1234.56")], "doc_id long, kind string, page int, text string")
    words = spark.createDataFrame([(d, 1, t, x, 0.1, 0.05, 0.02) for d in (1, 2) for t, x in (("Map", 0.1), ("Reference", 0.16), ("A1", 0.3), ("Census", 0.75), ("Tract", 0.81), ("99.9", 0.9))], WORDS)
    got = {(r["doc_id"], r["rule_id"]): (r["value"], r["confidence"], r["page"]) for r in reports.checked(pages, 2024, ["S-4", "S-6"], cross=False, words=words).collect()}
    assert got[1, "S-6"] == ("99.9", 0.82, 1) and got[2, "S-6"][0] == "1234.56" and got[1, "S-4"][0] == "Lot 1"


def test_marked_boxes_come_before_choices_of_the_text(spark):
    pages = spark.createDataFrame([(d, "report", 1, "[X] Rural Legal Description Lot 1") for d in (1, 2)], "doc_id long, kind string, page int, text string")
    words = spark.createDataFrame([(1, 1, t, x, 0.1, 0.05, 0.02) for t, x in (("X", 0.1), ("Urban", 0.15), ("Over", 0.3), ("75%", 0.35))], WORDS)
    cells = reports.with_words(reports.page_fields(pages), words)
    got = {(r["doc_id"], r["field_name"]): (r["value"], r["confidence"]) for r in cells.where("field_name in ('location', 'built_up', 'legal_description')").collect()}
    assert got[1, "location"] == ("Urban", 0.86) and got[2, "location"] == ("Rural", 0.55) and (1, "built_up") not in got and {(1, "legal_description"), (2, "legal_description")} <= set(got)


def test_addresses_with_house_numbers_of_any_length_follow_the_sql(spark, tmp_path):
    keys = [7, 8, *range(9998, 10005), 12346, 99998, 99999, *range(100000, 100004)]
    path = f"{tmp_path}/customer.parquet"
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"create view customer as select * from '{path}/*.parquet'")
    df = reading_queries.normalized_address(spark, str(tmp_path))
    want = duck.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLE_SQL['normalized_address']}) order by doc_id").fetchall()
    assert [tuple(r) for r in df.orderBy("doc_id").collect()] == want


def test_near_labels_work_values_out_once(spark):
    """No filter and no explode tests labels or values by itself: optimised, each was worked out again for every mention."""
    from docgauge.plans import spatial

    words = spark.createDataFrame([("d", 1, "County:", 0.1, 0.1, 0.1, 0.01), ("d", 1, "Travis", 0.25, 0.1, 0.1, 0.01)], "doc_id string, page int, text string, x double, y double, w double, h double")
    out = spatial.near_labels(words)
    assert [(r.field_name, r.value) for r in out.collect()] == [("county", "Travis")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Generate" in line and ("CASE" in line or "transform(" in line)]
    assert not [line for line in plan.split("\n") if "Filter" in line and ("regexp_replace" in line or "aggregate(" in line)]
