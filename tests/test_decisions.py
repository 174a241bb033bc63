"""The decision fold, locks, sessions, caches and status transitions."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docgauge.operators import decisions as D
from docgauge.operators import transitions as X

T0 = datetime(2024, 1, 1, 9, 0)
ITEM = "id long, status string, severity string, first_presented_at timestamp_ntz"
EVENT = "rule_result_id long, event_seq long, ts timestamp_ntz, reviewer_id long, decision string, comment string, session_token string, latency_ms long, acknowledged boolean"
REASON = "the report shows the corrected page"


def fold(spark, item, *events):
    rows = [(item[0], i, T0 + timedelta(minutes=i + 1), *e) for i, e in enumerate(events)]
    out = D.decided(spark.createDataFrame([item], ITEM), spark.createDataFrame(rows, EVENT)).orderBy("event_seq").collect()
    return [(r.verdict, r.status, r.reviewer_verified, r.override_pending) for r in out]


def test_verify_needs_time_and_acknowledgement(spark):
    late = (1, "verify", "BLOCKING", T0 + timedelta(hours=1))
    got = fold(spark, late, (7, "PASS", "ok", "s", 7999, True), (7, "PASS", "ok", "s", 8000, None), (7, "PASS", "ok", "s", 8000, True), (7, "PASS", " ok ", "s", 1, None), (8, "FAIL", "no", "other", 9000, True))
    assert [g[0] for g in got] == ["TOO_FAST", "NOT_ACKNOWLEDGED", "ACCEPTED", "DUPLICATE", "DECIDED_ELSEWHERE"]
    assert got[2][1:] == ("MANUAL_PASS", True, False)
    assert [g[0] for g in fold(spark, (1, None, None, T0), (7, "FAIL", "no", "s", None, None))] == ["ACCEPTED"]


def test_override_takes_two(spark):
    got = fold(spark, (1, "FAIL", "STANDARD", None), (7, "PASS", "too short", "s", 0, True), (7, "PASS", REASON, "s", 0, True), (7, "PASS", REASON, "s", 0, True), (7, "PASS", REASON + "!", "s", 0, True), (8, "PASS", REASON, "t", 0, True))
    assert [g[0] for g in got] == ["REASON_TOO_SHORT", "ACCEPTED", "DUPLICATE", "NEEDS_SECOND_REVIEWER", "ACCEPTED"]
    assert got[1][1:] == ("FAIL", None, True) and got[4][1:] == ("MANUAL_PASS", True, False)


def test_unknown_items_are_refused(spark):
    items = spark.createDataFrame([], ITEM)
    events = spark.createDataFrame([(9, 1, T0, 1, "PASS", None, "s", None, None)], EVENT)
    assert [r.verdict for r in D.decided(items, events).collect()] == ["UNKNOWN_ITEM"]
    assert D.decided(items, events.limit(0)).count() == 0


def test_many_items_are_folded_in_one_pass(spark):
    n = 60000
    items = spark.range(n).selectExpr("id", "if(id % 2 = 0, 'verify', 'fail') as status", "'STANDARD' as severity", "cast(null as timestamp_ntz) as first_presented_at")
    e = spark.range(3 * n).selectExpr("id div 3 as rule_result_id", "id as event_seq", "timestamp_ntz'2024-01-01 09:00:00' as ts", "id % 3 as reviewer_id", "'PASS' as decision", f"'{REASON}' as comment", "cast(id % 3 as string) as session_token", "if(id % 3 = 0, 10, 9000) as latency_ms", "true as acknowledged")
    out = D.decided(items, e)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()  # no Python group per item
    got = {(r.verdict, r.status): r["count"] for r in out.groupBy("verdict", "status").count().collect()}
    half = n // 2
    assert got == {("TOO_FAST", "verify"): half, ("ACCEPTED", "MANUAL_PASS"): 2 * half, ("DECIDED_ELSEWHERE", "MANUAL_PASS"): 2 * half, ("ACCEPTED", "fail"): half}


def test_locks_and_documents(spark):
    rows = [(1, 1, 5, 0, False), (2, 1, 5, 0, False), (2, 1, -5, 0, False), (2, 1, -5, 3, None), (2, 1, -5, 3, True), (2, None, None, 0, False)]
    df = spark.createDataFrame(rows, "me long, by long, left int, prior int, ack boolean").withColumn("till", F.expr("timestamp_ntz'2024-01-01 09:00:00' + make_interval(0,0,0,0,0,left)"))
    got = [r.s for r in df.select(D.lock_state(F.col("by"), F.col("till"), F.col("me"), F.expr("timestamp_ntz'2024-01-01 09:00:00'"), F.col("prior"), F.col("ack")).alias("s")).collect()]
    assert got == ["GRANTED", "BLOCKED", "GRANTED", "CONFIRM", "GRANTED", "GRANTED"]
    df = spark.createDataFrame([("a", "a", 1, 1), ("a", "b", 1, 1), ("a", "a", 1, 2), (None, "b", None, 2)], "p string, c string, pv int, cv int")
    assert [r[0] for r in df.select(D.document_current(*map(F.col, ("p", "c", "pv", "cv")))).collect()] == [True, False, False, True]


def test_sessions_and_caches(spark):
    sessions = spark.createDataFrame([(1, "a", T0, None, "IDLE"), (2, "b", T0, T0, "ENDED")], "user_id long, session_token string, started_at timestamp_ntz, ended_at timestamp_ntz, status string")
    logins = spark.createDataFrame([(1, "c", T0 + timedelta(hours=1)), (1, "d", T0 + timedelta(hours=2))], "user_id long, session_token string, ts timestamp_ntz")
    got = {r.session_token: (r.status, r.ended_at) for r in D.sessions_started(sessions, logins).collect()}
    assert got == {"a": ("ENDED", T0 + timedelta(hours=1)), "b": ("ENDED", T0), "c": ("ENDED", T0 + timedelta(hours=2)), "d": ("ACTIVE", None)}
    cache = spark.createDataFrame([("k", "v")], "cache_key string, response string")
    hits, misses = D.cache_lookup(spark.createDataFrame([("k",), ("m",), ("m",)], "cache_key string"), cache)
    assert hits.count() == 1 and misses.count() == 1
    new = spark.createDataFrame([("k", "other"), ("n", "w")], "cache_key string, response string")
    assert {tuple(r) for r in D.put_if_absent(cache, new).collect()} == {("k", "v"), ("n", "w")}


def test_first_presented_is_set_once(spark):
    items = spark.createDataFrame([(1, None), (2, T0), (3, None)], "id long, first_presented_at timestamp_ntz")
    shown = spark.createDataFrame([(1, T0 + timedelta(hours=2)), (1, T0 + timedelta(hours=1)), (2, T0 + timedelta(hours=1))], "rule_result_id long, ts timestamp_ntz")
    assert {r.id: r.first_presented_at for r in D.first_presented(items, shown).collect()} == {1: T0 + timedelta(hours=1), 2: T0, 3: None}


def test_batch_transitions(spark):
    rows = [(1, "UPLOADED", "x", 1), (2, "QC_PROCESSING", None, 1), (3, "COMPLETED", None, 1), (4, None, None, 1)]
    df = spark.createDataFrame(rows, "id long, status string, error_message string, version int").withColumns({"updated_at": F.lit(T0).cast("timestamp_ntz"), "assigned_reviewer_id": F.lit(None).cast("long")})
    now = F.expr("timestamp_ntz'2024-01-01 12:00:00'")
    one = {r.id: (r.status, r.error_message, r.version) for r in X.claim(df, now).collect()}
    assert one == {1: ("QC_PROCESSING", None, 2), 2: ("QC_PROCESSING", None, 1), 3: ("COMPLETED", None, 1), 4: (None, None, 1)}
    assert {r.id: r.status for r in X.assign(df, F.lit(5), now).collect()} == {1: "REVIEW_PENDING", 2: "QC_PROCESSING", 3: "REVIEW_PENDING", 4: None}
    assert {r.id: r.error_message for r in X.stop(df, now, "stopped").collect()}[2] == "stopped"
    action = {r.id: (r.action, r.status) for r in X.reconciled(df, now, True).collect()}
    assert action[2] == ("ERROR", "ERROR") and action[1] == ("NONE", "UPLOADED")


def test_counters_lose_a_spelling_unless_told_otherwise(spark):
    results = spark.createDataFrame([(1,)], "qc_result_id long")
    items = spark.createDataFrame([(1, "fail"), (1, "fail"), (1, "FAIL"), (1, "pass")], "qc_result_id long, status string")
    assert X.counters(results, items, "qc_result_id").first().fail_count == 2
    assert X.counters(results, items, "qc_result_id", faithful=False).first().fail_count == 3
