"""Boxes against plain loops, streams across restarts, stored models across sessions, sinks written twice."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docgauge.operators import boxes as B
from docgauge.plans import keeping_queries, models, training
from docgauge.sources import tables
from docgauge.streaming import learning, sessions

T0 = datetime(2024, 1, 1)


def iou(a, b):
    w, h = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]), min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    return 0 if w < 0 or h < 0 else w * h / (a["w"] * a["h"] + b["w"] * b["h"] - w * h)


def loop(rows, order, near):
    kept = set()
    for page in {r["page"] for r in rows}:
        held = []
        for r in sorted((r for r in rows if r["page"] == page), key=order):
            if not any(near(r, k) for k in held):
                held.append(r)
        kept |= {(page, r["id"]) for r in held}
    return kept


def test_boxes_against_plain_loops(spark):
    rng = random.Random(3)
    rows = [{"page": rng.choice([1, 1, 1, 2, None]), "id": i, "x": float(rng.randint(-30, 150)), "y": float(rng.randint(0, 90)), "w": rng.choice([5.0, 20.0, 130.0]), "h": rng.choice([8.0, 25.0]), "score": rng.choice([0.5, 0.7, 0.9, None])} for i in range(150)]
    rows += [{**rows[0], "id": 200 + i, "page": 1} for i in range(5)]  # ties on one spot
    df = spark.createDataFrame(rows, "page int, id int, x double, y double, w double, h double, score double").withColumn("kept_before", F.lit("clash"))
    got = {(r.page, r.id) for r in B.suppressed(df, ["page"], "id", ["score"]).where("kept").collect()}
    assert got == loop(rows, lambda r: (-r["score"] if r["score"] is not None else float("inf"), r["id"]), lambda a, b: iou(a, b) > 0.3)
    got = {(r.page, r.id) for r in B.distinct_boxes(df, ["page"], "id").where("kept").collect()}
    assert got == loop(rows, lambda r: (r["x"] * 10000 + r["y"], r["id"]), lambda a, b: abs(a["x"] - b["x"]) < 15 and abs(a["y"] - b["y"]) < 15)
    assert B.suppressed(df.limit(0), ["page"], "id", ["score"]).count() == 0


def test_small_pages_take_no_rounds_and_large_ones_agree(spark, monkeypatch):
    rng = random.Random(5)
    rows = [{"page": rng.choice([1, 1, 1, 1, 2, 3, None]), "id": i, "x": float(rng.randint(0, 90)), "y": float(rng.randint(0, 90))} for i in range(120)]
    near = lambda a, b: abs(a["x"] - b["x"]) < 15 and abs(a["y"] - b["y"]) < 15
    want = loop(rows, lambda r: (r["x"] * 10000 + r["y"], r["id"]), near)
    df = spark.createDataFrame(rows, "page int, id int, x double, y double")
    kept = lambda: {(r.page, r.id) for r in B.distinct_boxes(df, ["page"], "id").where("kept").collect()}
    rounds, ran = B.by_rounds, []
    monkeypatch.setattr(B, "by_rounds", lambda *a: ran.append(1) or rounds(*a))
    assert kept() == want and not ran
    monkeypatch.setattr(B, "MOST", 30)  # page 1 alone is larger
    assert kept() == want and ran
    nowhere = spark.createDataFrame([(1, i, None, 5.0, 1.0, 1.0, 0.5) for i in range(40)], "page int, id int, x double, y double, w double, h double, score double")
    assert B.suppressed(nowhere, ["page"], "id", ["score"]).where("kept").count() == 40


def test_repeated_lines_give_one_box_in_any_order(spark, tmp_path):
    rows = [(1, 1, 40, 9, 1.0), (1, 1, 2, 9, 3.0), (1, 1, 2, 4, 4.0), (1, 2, 1, 1, 2.0)]
    got = []
    for name, given in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(given, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        got.append(sorted(tuple(r) for r in keeping_queries.boxes(spark, f"{tmp_path}/{name}").collect()))
    assert got[0] == got[1] == [(1, 1, 6.0, 12.0, 20.0, 21.0, 4.0), (1, 2, 3.0, 3.0, 20.0, 22.0, 2.0)]


def land(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{number}")


def test_a_correction_takes_effect_in_the_next_batch(spark, tmp_path):
    schema = "kind string, id long, text string, original_status string, original_value string, corrected_value string"
    feedback = "id long, original_status string, original_value string, corrected_value string"
    text = lambda i, t: ("text", i, t, None, None, None)
    told = lambda i, a, b, s="OCR_ERROR": ("feedback", i, None, s, a, b)
    now = [0.0]
    spark.createDataFrame([(0, "OCR_ERROR", "Borower", "Borrower")], feedback).write.parquet(f"{tmp_path}/fb/seed")
    cache = learning.Corrections(spark, f"{tmp_path}/fb", feedback, 300, lambda: now[0])
    steps = [[text(1, "Borower of Lendr"), text(2, None)], [told(5, "Lendr", "Lender"), text(3, "Lendr")], [told(6, "Lendr", "LENDER"), told(7, "x", "y", "FAIL")], [text(4, "Lendr x")]]
    for i, rows in enumerate(steps):
        land(spark, tmp_path, i, rows, schema)
        stream = sessions.read(spark, f"{tmp_path}/in/*", schema, files=1)
        q = learning.corrected_texts(stream, cache, f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination(120)
        assert q.exception() is None
    got = {r.id: (r.text, r.changed) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").collect()}
    assert got == {1: ("Borrower of Lendr", True), 2: (None, False), 3: ("Lender", True), 4: ("LENDER x", True)}
    spark.createDataFrame([(9, "OCR_ERROR", "late", "later")], feedback).write.parquet(f"{tmp_path}/fb/other")  # not through the stream
    assert ("late", "later") not in cache.current()
    now[0] = 301.0
    assert ("late", "later") in cache.current()


def test_sub_progress_merges_only_into_a_parent_and_survives_a_restart(spark, tmp_path):
    schema = "token string, ts timestamp, source string, stage string, percent double"
    row = lambda k, m, s, stage, p: (k, T0 + timedelta(minutes=m), s, stage, float(p))
    steps = [
        [row("a", 0, "child", "early", 5), row("a", 1, "parent", "ocr", 10), row("b", 1, "child", "lost", 9)],
        [row("a", 2, "child", "page 1", 50), row("a", 0, "child", "old", 1)],
        [row("a", 3, "parent", "rules", 60), row("a", 3, "child", "rule 1", 20)],
        [row("a", 4, "parent", "done", 100), row("a", 5, "child", "after", 99)],
    ]
    for i, rows in enumerate(steps):  # every step is a query of its own, from the same checkpoint
        land(spark, tmp_path, i, rows, schema)
        df = learning.merged_progress(sessions.read(spark, f"{tmp_path}/in/*", schema, files=1))
        q = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    got = sorted(((r.ts, r.stage, r.percent, r.sub_stage, r.sub_percent) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda g: (g[0], g[3] or ""))
    at = lambda m: T0 + timedelta(minutes=m)
    assert [(g[0], g[1], g[2], g[3]) for g in got if g[3] is None] == [(at(1), "ocr", 10.0, None), (at(3), "rules", 60.0, None), (at(4), "done", 100.0, None)]
    assert [g[1:] for g in got if g[3] is not None] == [("ocr", 10.0, "page 1", 50.0), ("rules", 60.0, "rule 1", 20.0)]


def test_ring_buffer_over_restarts_and_repeats(spark, tmp_path):
    schema, rng, every = "event_id long, ts timestamp, value double", random.Random(1), []
    for i in range(4):
        rows = [(i * 100 + j, T0 + timedelta(seconds=rng.randint(0, 50)), 1.0) for j in range(30)]
        every += rows
        land(spark, tmp_path, i, rows, schema)
        q = learning.ring_buffer(sessions.read(spark, f"{tmp_path}/in/*", schema, files=1), f"{tmp_path}/buf", f"{tmp_path}/ck", 20)
        q.awaitTermination(120)
        assert q.exception() is None
        want = sorted(((t, e) for e, t, _ in every), reverse=True)[:20]
        assert sorted(((r.ts, r.event_id) for r in learning.buffered(spark, f"{tmp_path}/buf").collect()), reverse=True) == want
    q = learning.ring_buffer(sessions.read(spark, f"{tmp_path}/in/*", schema, files=1), f"{tmp_path}/again", f"{tmp_path}/ck2", 20)  # all at once
    q.awaitTermination(120)
    assert sorted(((r.ts, r.event_id) for r in learning.buffered(spark, f"{tmp_path}/again").collect()), reverse=True) == want


def test_stored_models(spark, tmp_path):
    rows = spark.createDataFrame([(f"the market is stable and typical {i}", "CANNED") for i in range(15)] + [(f"absorption of 4.2 percent on {i} Elm Street", "SPECIFIC") for i in range(15)], "text string, label string")
    model, report = training.commentary_classifier(rows)
    assert not report["skipped"]
    path = f"{tmp_path}/models/commentary"
    asked = rows.select("text").unionByName(spark.createDataFrame([(None,), (" ",)], "text string"))
    assert {(r.label, r.confidence, r.model_version) for r in models.scored(asked, path).collect()} == {(None, None, None)}
    assert models.save(spark, model, path) == 1 and models.save(spark, model, path) == 2
    model.write().save(f"{path}/v3")  # broke off before its mark
    got = {r.text: r for r in models.scored(asked, path).collect()}
    fitted = {r.text: max(r.probability) for r in model.transform(rows).collect()}
    assert all(got[t].confidence == p and got[t].model_version == 2 for t, p in fitted.items())
    assert got["absorption of 4.2 percent on 3 Elm Street"].label == "SPECIFIC" and got[None].label is None and got[" "].confidence is None
    assert models.scored(asked, path, 1).first().model_version == 1 and models.scored(asked, path, 7).first().model_version is None


def test_sinks_replace_batches_and_stand_a_failure(spark, tmp_path):
    schema = "batch_id long, doc_id long, finished_at timestamp_ntz, results array<struct<rule_id:string,status:string,severity:string,field:string,value:string,confidence:double,page:int>>"
    one = lambda s: ("R", s, None, "f", "v", 0.5, 1)
    docs = spark.createDataFrame([(1, 10, T0, [one("pass"), one("manual pass")]), (2, 20, T0, [one("FAIL"), one(None)]), (2, 21, T0, [])], schema)
    path = str(tmp_path / "store")
    tables.store_documents(docs, path)
    tables.store_documents(docs.where("batch_id = 2"), path)  # the same batch again
    read = lambda: sorted((int(r.batch_id), r.doc_id, r.status or "", r.needs_verification) for r in spark.read.parquet(f"{path}/results").collect())
    want = [(1, 10, "MANUAL_PASS", True), (1, 10, "PASS", False), (2, 20, "", True), (2, 20, "FAIL", True)]
    assert read() == want
    assert {(r.doc_id, r.detail) for r in spark.read.parquet(f"{path}/audit").collect()} == {(10, "passed 1, failed 0, verify 0"), (20, "passed 0, failed 1, verify 0"), (21, "passed 0, failed 0, verify 0")}
    bad = tables.result_rows(docs).repartition(4).withColumn("value", F.when(F.col("doc_id") == 20, F.raise_error(F.lit("halfway")).cast("string")).otherwise("new"))
    with pytest.raises(Exception, match="halfway"):
        tables.replace_batches(bad, f"{path}/results")
    assert read() == want and {r.value for r in spark.read.parquet(f"{path}/results").collect()} == {"v"}
