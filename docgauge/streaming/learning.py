"""Streams that keep what they learned: corrections that take effect at once, merged sub-progress, a bounded buffer."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Corrections that a text is run through at most; people make them one by one, and more than this is an error.
MOST_CORRECTIONS = 20_000


def learned(feedback: DataFrame) -> DataFrame:
    """(wrong, right, place) from reported scanning errors: the latest correction of a text, in the order of the first."""
    rows = feedback.where("original_status = 'OCR_ERROR' and original_value <> '' and corrected_value <> ''")
    return rows.groupBy(F.col("original_value").alias("wrong")).agg(F.max_by("corrected_value", "id").alias("right"), F.min("id").alias("place"))


def corrected(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """``text`` after all literal replacements, one after another; a null text stays null."""
    if not pairs:
        return text
    both = F.arrays_zip(F.lit([w for w, _ in pairs]).alias("wrong"), F.lit([r for _, r in pairs]).alias("right"))
    return F.aggregate(both, text, lambda t, p: F.replace(t, p["wrong"], p["right"]))


class Corrections:
    """The learned corrections of a feedback folder and its subfolders, read again when old or when feedback has arrived."""

    def __init__(self, spark: SparkSession, path: str, schema: str, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.schema, self.seconds, self.clock = spark, path, schema, seconds, clock
        self.pairs: list[tuple[str, str]] = []
        self.loaded_at: float | None = None

    def invalidate(self) -> None:
        self.loaded_at = None

    def current(self) -> list[tuple[str, str]]:
        if self.loaded_at is None or self.clock() - self.loaded_at >= self.seconds:
            rows = learned(self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)).orderBy("place").limit(MOST_CORRECTIONS + 1).collect()
            if len(rows) > MOST_CORRECTIONS:
                raise ValueError(f"more than {MOST_CORRECTIONS} corrections")
            self.pairs, self.loaded_at = [(r["wrong"], r["right"]) for r in rows], self.clock()
        return self.pairs


def corrected_texts(stream: DataFrame, cache: Corrections, out: str, checkpoint: str) -> StreamingQuery:
    """Texts and feedback in one stream: rows with ``kind`` feedback join the folder first, then the batch's texts are corrected.

    Columns: kind, id, text, original_status, original_value, corrected_value. A micro-batch that brings feedback
    invalidates the cache, so its own texts already get the correction; without any, corrections are at most as old as the
    cache allows. A repeated micro-batch replaces what it wrote.
    """

    def step(batch: DataFrame, number: int) -> None:
        told = batch.where("kind = 'feedback'").select("id", "original_status", "original_value", "corrected_value")
        if told.limit(1).count():
            told.write.mode("overwrite").parquet(f"{cache.path}/batch-{number}")
            cache.invalidate()
        texts = batch.where("kind = 'text'")
        fixed = corrected(F.col("text"), cache.current())
        texts.select("id", fixed.alias("text"), F.coalesce(fixed != F.col("text"), F.lit(False)).alias("changed")).write.mode("overwrite").parquet(f"{out}/batch-{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MERGED = "token string, ts timestamp, stage string, percent double, sub_stage string, sub_percent double"


def merged_progress(updates: DataFrame, late: str = "10 minutes", ttl_seconds: int = 600) -> DataFrame:
    """A row per accepted update: the parent's state with its worker's latest sub-state.

    ``updates``: token, ts, source (parent or child), stage, percent. A child's update counts only if its parent's state
    exists, is not done (100 percent) and is not older than the state; a parent's new stage clears the sub-state. State
    leaves after ``ttl_seconds`` of silence by event time.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = list(state.get) if state.exists else None
        rows, out = pd.concat(list(batches)), []
        rows["first"] = rows["source"] != "parent"  # of one time the parent comes first
        for r in rows.sort_values(["ts", "first"], kind="stable").itertuples():
            at = r.ts.value
            if r.source == "parent":
                if now is not None and at < now[0]:
                    continue
                same = now is not None and now[1] == r.stage
                now = [at, r.stage, float(r.percent), now[3] if same else None, now[4] if same else None]
            elif now is None or now[2] >= 100 or at < now[0]:
                continue
            else:
                now[0], now[3], now[4] = at, r.stage, float(r.percent)
            out.append((key[0], pd.Timestamp(now[0]), *now[1:]))
        if now is not None:
            state.update(tuple(now))
            state.setTimeoutTimestamp(max(now[0] // 1_000_000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["token", "ts", "stage", "percent", "sub_stage", "sub_percent"])

    kept = "ts long, stage string, percent double, sub_stage string, sub_percent double"
    return updates.withWatermark("ts", late).groupBy("token").applyInPandasWithState(step, MERGED, kept, "append", GroupStateTimeout.EventTimeTimeout)


def latest(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The ``n`` last rows: each partition gives its own last ones, so no more than those are sorted together."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def ring_buffer(stream: DataFrame, path: str, checkpoint: str, n: int = 10_000, order: tuple[str, ...] = ("ts", "event_id")) -> StreamingQuery:
    """Keeps the latest ``n`` rows of a stream, as the table ``path``/<micro-batch>, whose newest folder counts.

    Every micro-batch merges its own last rows with the buffer before it, never with older events. A repeated micro-batch
    starts from the same buffer and replaces its own folder, so a restart gives the same rows.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = files.getFileSystem(spark._jsc.hadoopConfiguration())
        held = sorted(int(s.getPath().getName()) for s in system.listStatus(files) if s.getPath().getName().isdigit()) if system.exists(files) else []
        past = [h for h in held if h < number]
        rows = latest(batch, n, list(order))
        if past:
            rows = latest(rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/{past[-1]}")), n, list(order))
        rows.write.mode("overwrite").parquet(f"{path}/{number}")
        for old in past[:-1]:  # the buffer before this one stays for a repeat
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def buffered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a ring buffer."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark._jsc.hadoopConfiguration())
    newest = max(int(s.getPath().getName()) for s in system.listStatus(files) if s.getPath().getName().isdigit())
    return spark.read.parquet(f"{path}/{newest}")
