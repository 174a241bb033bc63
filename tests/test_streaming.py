"""Streams over files that arrive: the same rows as the batch form, whatever the micro-batches."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docgauge.streaming import sessions as S

T0 = datetime(2024, 1, 1)


def land(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return S.read(spark, f"{folder}/in/*", schema, files=1)


def drain(df, folder, mode):
    q = df.writeStream.format("parquet" if mode == "append" else "memory").queryName("t").outputMode(mode).option("checkpointLocation", f"{folder}/ck").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and not q.isActive
    return df.sparkSession.read.parquet(f"{folder}/out") if mode == "append" else df.sparkSession.table("t")


def test_sessions_end_at_gaps(spark, tmp_path):
    at = lambda u, m: (u, T0 + timedelta(minutes=m), 1.0)
    stream = land(spark, tmp_path, [[at(1, 0), at(1, 10), at(2, 3)], [at(1, 40), at(2, 17)], [at(9, 3000)], [at(9, 6000)]], "user_id long, ts timestamp, value double")
    out = drain(S.user_sessions(stream), tmp_path, "append")
    got = {(r.user_id, r.started_at - T0, r.actions) for r in out.where("user_id < 9").collect()}
    assert got == {(1, timedelta(0), 2), (1, timedelta(minutes=40), 1), (2, timedelta(minutes=3), 2)}


def test_resubmissions_are_dropped(spark, tmp_path):
    row = lambda i, t, c, m: (i, t, "PASS", c, T0 + timedelta(minutes=m))
    stream = land(spark, tmp_path, [[row(1, "s", "ok", 0), row(1, "s", "ok", 1)], [row(1, "s", "ok", 2), row(1, "s", "no", 3), row(2, "s", "ok", 3)]], "rule_result_id long, session_token string, decision string, comment string, ts timestamp")
    out = drain(S.distinct_submissions(stream), tmp_path, "append")
    assert sorted((r.rule_result_id, r.comment) for r in out.collect()) == [(1, "no"), (1, "ok"), (2, "ok")]


def test_progress_keeps_the_latest_and_expires(spark, tmp_path):
    row = lambda k, m, s, p: (k, T0 + timedelta(minutes=m), s, p)
    stream = land(spark, tmp_path, [[row("a", 0, "start", 0), row("b", 1, "start", 0)], [row("a", 5, "ocr", 40)], [row("a", 3, "late", 20)], [row("b", 90, "end", 100)], [row("c", 200, "x", 1)]], "token string, ts timestamp, stage string, percent int")
    out = drain(S.progress(stream), tmp_path, "append").collect()
    last = [r for r in out if r.token == "a" and not r.expired]
    assert max((r.updated_at, r.stage, r.percent) for r in last) == (T0 + timedelta(minutes=5), "ocr", 40)
    assert all(r.started_at == T0 for r in last)
    assert [(r.stage, r.percent) for r in out if r.token == "a" and r.expired] == [("ocr", 40)]


def test_topics_are_checked(spark, tmp_path):
    stream = land(spark, tmp_path, [[("a", T0)]], "token string, ts timestamp")
    with pytest.raises(ValueError, match="topic"):
        S.broadcast_batches(stream, "other/1", str(tmp_path / "push"), str(tmp_path / "ck2"))
    q = S.broadcast_batches(stream, "batch/1", str(tmp_path / "push"), str(tmp_path / "ck2"))
    q.awaitTermination(60)
    assert spark.read.json(f"{tmp_path}/push/batch/1/*").select("token").first()[0] == "a"


def test_daily_trend_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in/0")
    out = drain(S.daily_trend(S.read(spark, f"{tmp_path}/in/*", "ts timestamp, value double", files=1), "40 days"), tmp_path, "complete")
    want = {r.day: r.n for r in events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert {r.day: r.n for r in out.collect()} == want
