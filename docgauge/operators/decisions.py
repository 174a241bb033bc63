"""Reviewer decisions: an ordered event log per checked item, folded into the item's state and a verdict on every event."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_LATENCY_MS = 8000
MIN_REASON = 20
LOCK_MINUTES = 30
VERDICTS = "rule_result_id long, event_seq long, verdict string, status string, reviewer_verified boolean, override_pending boolean, reviewer_comment string, decided_by long"


def verdict(state: dict, e: dict) -> str:
    """ACCEPTED, DUPLICATE, or the reason for which an event is refused; changes ``state`` if the event is accepted."""
    status = (state["status"] or "").strip().lower() or "verify"
    comment = (e["comment"] or "").strip()
    passed = (e["decision"] or "").strip().upper() == "PASS"
    same = state["token"] == e["session_token"] and comment == (state["comment"] or "").strip()
    if same and (state["pending"] or (state["verified"] is True and status == "manual_pass") if passed else state["verified"] is False and status == "fail"):
        return "DUPLICATE"
    if state["verified"] is not None and state["token"] not in (None, e["session_token"]) and not state["pending"]:
        return "DECIDED_ELSEWHERE"
    if status == "verify":
        seen = (e["ts"] - state["presented"]).total_seconds() * 1000 if state["presented"] is not None else 0
        if max(e["latency_ms"] or 0, seen) < MIN_LATENCY_MS:
            return "TOO_FAST"
        if (state["severity"] or "").strip().upper() == "BLOCKING" and not e["acknowledged"]:
            return "NOT_ACKNOWLEDGED"
    if passed and status == "fail":
        if len(comment) < MIN_REASON:
            return "REASON_TOO_SHORT"
        if not state["pending"]:  # a first reviewer asks, a second one approves
            state |= {"verified": None, "pending": True, "requested_by": e["reviewer_id"]}
        elif state["requested_by"] is not None and state["requested_by"] == e["reviewer_id"]:
            return "NEEDS_SECOND_REVIEWER"
        else:
            state |= {"verified": True, "pending": False, "status": "MANUAL_PASS"}
    else:
        state |= {"verified": passed, "pending": False, "status": "MANUAL_PASS" if passed else "FAIL"}
    state |= {"comment": comment if passed and status == "fail" else e["comment"], "token": e["session_token"], "by": e["reviewer_id"]}
    return "ACCEPTED"


def decided(items: DataFrame, events: DataFrame) -> DataFrame:
    """A row per event: its verdict and the item's state behind it. Events are folded by (ts, event_seq) per item.

    ``items``: id, status, severity, first_presented_at. Events of unknown items are refused as UNKNOWN_ITEM. A null time
    or latency counts as no evidence of reading; events without a time come last. Tasks stream their items in order and
    hold one state, so neither the number of items nor the length of a log costs memory.
    """
    known = items.select(F.col("id").alias("rule_result_id"), F.col("status").alias("_status"), F.col("severity").alias("_severity"), F.col("first_presented_at").cast("timestamp_ntz").alias("_presented"), F.lit(True).alias("_known"))
    joined = events.select("rule_result_id", "event_seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "reviewer_id", "decision", "comment", "session_token", "latency_ms", "acknowledged").join(known, "rule_result_id", "left")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: tuple = ()
        item, state = none, {}
        columns = {"rule_result_id": pa.int64(), "event_seq": pa.int64(), "verdict": pa.string(), "status": pa.string(), "reviewer_verified": pa.bool_(), "override_pending": pa.bool_(), "reviewer_comment": pa.string(), "decided_by": pa.int64()}
        for batch in batches:
            rows = []
            for e in batch.to_pylist():
                if item is none or e["rule_result_id"] != item:
                    item = e["rule_result_id"]
                    state = {"status": e["_status"], "severity": e["_severity"], "presented": e["_presented"], "verified": None, "pending": False, "requested_by": None, "comment": None, "token": None, "by": None}
                said = verdict(state, e) if e["_known"] else "UNKNOWN_ITEM"
                rows.append((item, e["event_seq"], said, state["status"], state["verified"], state["pending"], state["comment"], state["by"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)] if rows else [pa.array([], t) for t in columns.values()], names=list(columns))

    ordered = joined.repartition("rule_result_id").sortWithinPartitions("rule_result_id", F.asc_nulls_last("ts"), F.asc_nulls_last("event_seq"))
    return ordered.mapInArrow(fold, VERDICTS)


def document_current(processed_hash: Column, current_hash: Column, processed_version: Column, current_version: Column) -> Column:
    """False where the file's content is another, or newer, than the one that was checked; unknown values don't object."""
    return ~(F.coalesce(processed_hash != current_hash, F.lit(False)) | F.coalesce(current_version > processed_version, F.lit(False)))


def lock_state(locked_by: Column, expires_at: Column, reviewer: Column, as_of: Column, prior: Column, acknowledged: Column) -> Column:
    """What opening a review yields: BLOCKED by another reviewer, CONFIRM where saved decisions await, else GRANTED."""
    active = F.coalesce(locked_by.isNotNull() & (expires_at > as_of), F.lit(False))
    return F.when(active & (locked_by != reviewer), "BLOCKED").when(~active & (prior > 0) & ~F.coalesce(acknowledged, F.lit(False)), "CONFIRM").otherwise("GRANTED")


def first_presented(items: DataFrame, shown: DataFrame) -> DataFrame:
    """Items with the first time that they were shown; a stamp that is there stays."""
    first = shown.groupBy("rule_result_id").agg(F.min("ts").alias("_shown"))
    return items.join(first, items.id == first.rule_result_id, "left").withColumn("first_presented_at", F.coalesce("first_presented_at", "_shown")).select(*items.columns)


def sessions_started(sessions: DataFrame, logins: DataFrame) -> DataFrame:
    """A login ends the user's open sessions and opens one: session rows with ``ended_at`` and status as they follow.

    ``logins``: user_id, session_token, ts. Logins and sessions of a user form one ordered stream; each session that is
    open ends when the next begins.
    """
    new = logins.select("user_id", "session_token", F.col("ts").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("ended_at"), F.lit("ACTIVE").alias("status"))
    both = sessions.select("user_id", "session_token", "started_at", "ended_at", "status").unionByName(new)
    following = F.lead("started_at").over(Window.partitionBy("user_id").orderBy("started_at", "session_token"))
    open_ = F.col("status").isin("ACTIVE", "IDLE")
    ended = both.withColumn("_next", following)
    return ended.withColumn("ended_at", F.when(open_, F.coalesce("ended_at", "_next")).otherwise(F.col("ended_at"))).withColumn("status", F.when(open_ & F.col("_next").isNotNull(), "ENDED").otherwise(F.col("status"))).drop("_next")


def cache_lookup(asked: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits with their cached response, distinct misses); hits count is the caller's to add with ``changed``."""
    return asked.join(cache, key), asked.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def put_if_absent(cache: DataFrame, new: DataFrame, key: str = "cache_key") -> DataFrame:
    return cache.unionByName(new.join(cache.select(key), key, "left_anti").dropDuplicates([key]))
