"""Streaming forms of the stateful operators. Event time with a watermark stands for the service's clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """A stream over the files that arrive in a folder; at most ``files`` of them a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def daily_trend(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Per day: mean value and rows; a day is final when the watermark passes its end."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.avg("value").alias("avg_value"), F.count("*").alias("n"))
    return days.select(F.to_date("w.start").alias("day"), "avg_value", "n")


def user_sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: a gap without activity ends one."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("actions"), F.max("ts").alias("last_active_at"))
    return out.select("user_id", F.col("w.start").alias("started_at"), "last_active_at", "actions")


def distinct_submissions(decisions: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Decisions without resubmissions: same item, session, decision and comment within the watermark."""
    return decisions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["rule_result_id", "session_token", "decision", "comment"])


PROGRESS = "token string, started_at timestamp, updated_at timestamp, stage string, percent int, expired boolean"


def progress(updates: DataFrame, ttl_seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """Latest state per token, with its first time; a token that is silent for ``ttl_seconds`` leaves with ``expired``.

    ``updates``: token, ts (timestamp), stage, percent. Late updates never overwrite a later state.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            started, updated, stage, percent = state.get
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(started), pd.Timestamp(updated), stage, percent, True)], columns=["token", "started_at", "updated_at", "stage", "percent", "expired"])
            return
        started, updated, stage, percent = state.get if state.exists else (None, None, None, None)
        for b in batches:
            for ts, s, p in zip(b["ts"], b["stage"], b["percent"], strict=True):
                at = ts.value
                started = at if started is None else min(started, at)
                if updated is None or at >= updated:
                    updated, stage, percent = at, s, int(p) if p is not None and p == p else percent
        state.update((started, updated, stage, percent))
        state.setTimeoutTimestamp(max(updated // 1_000_000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], pd.Timestamp(started), pd.Timestamp(updated), stage, percent, False)], columns=["token", "started_at", "updated_at", "stage", "percent", "expired"])

    return updates.withWatermark("ts", late).groupBy("token").applyInPandasWithState(step, PROGRESS, "started long, updated long, stage string, percent int", "append", GroupStateTimeout.EventTimeTimeout)


def broadcast_batches(df: DataFrame, topic: str, path: str, checkpoint: str, prefixes: tuple[str, ...] = ("batch/", "reviewer/")):
    """Push sink: every micro-batch goes to the topic's folder as JSON lines; only known topic prefixes are served."""
    if not topic.startswith(prefixes):
        raise ValueError(f"topic not allowed: {topic}")

    def push(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/{topic}/{batch_id}")  # a retried micro-batch replaces its own folder

    return df.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
