"""Dashboard and monitoring aggregates. Every function is a pure DataFrame transformation with an explicit as-of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.numeric import percent, round_half_up_floor


def since(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    return df.where(F.col(ts) >= F.expr(f"timestamp_ntz'{as_of}' - interval {days} days"))


def daily_trend(df: DataFrame, ts: str, value: str, hit: Column) -> DataFrame:
    """Per calendar day: mean value, share of hits in percent, rows. Days without rows are absent."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.avg(value).alias("m"), F.count_if(hit).alias("h"), F.count("*").alias("n"))
    return days.select("day", round_half_up_floor(F.col("m")).alias("avg_value"), percent(F.col("h"), F.col("n")).alias("hit_pct"), "n")


def overview(df: DataFrame, value: str, hit: Column, good: Column) -> DataFrame:
    """One row: files, mean in seconds, hit rate and pass rate; rates are 0 where there are no files."""
    one = df.agg(F.count("*").alias("files"), F.avg(value).alias("m"), F.count_if(hit).alias("h"), F.count_if(good).alias("g"))
    files = F.col("files")
    return one.select("files", F.coalesce(round_half_up_floor(F.col("m") / 1000.0), F.lit(0.0)).alias("avg_seconds"), percent(F.col("h"), files).alias("cache_hit_pct"), percent(F.col("g"), files).alias("pass_pct"))


def distribution(df: DataFrame, key: str, unknown: str = "unknown") -> DataFrame:
    """Rows per value; null counts as ``unknown``."""
    return df.groupBy(F.coalesce(F.col(key), F.lit(unknown)).alias(key)).agg(F.count("*").alias("n"))


def breakdown(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row: a count per listed value and its percentage of their total."""
    counts = df.agg(*[F.count_if(F.col(key) == v).alias(f"n_{v.lower()}") for v in values])
    total = sum((F.col(f"n_{v.lower()}") for v in values), F.lit(0))
    return counts.select("*", *[percent(F.col(f"n_{v.lower()}"), total).alias(f"pct_{v.lower()}") for v in values])


def latency_by_actor(df: DataFrame, actor: str, latency: str, at_least: int, below: float | None = None) -> DataFrame:
    """Mean latency and decisions per actor with enough decisions; optionally only suspiciously fast actors."""
    out = df.where(F.col(actor).isNotNull() & F.col(latency).isNotNull()).groupBy(actor).agg(F.avg(latency).alias("m"), F.count("*").alias("decisions"))
    out = out.where(F.col("decisions") >= at_least)
    return (out if below is None else out.where(F.col("m") < below)).withColumnRenamed("m", "avg_latency")


def counts_by_actor(df: DataFrame, actor: str, at_least: int = 1) -> DataFrame:
    return df.where(F.col(actor).isNotNull()).groupBy(actor).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def named(df: DataFrame, people: DataFrame, key: str, id_col: str, name: Column) -> DataFrame:
    """Aggregate rows with a person's name; rows of unknown people are dropped."""
    return df.join(people.select(F.col(id_col).alias(key), name.alias("name")), key)


def totals_by_actor(df: DataFrame, actor: str, columns: list[str]) -> DataFrame:
    return df.groupBy(actor).agg(*[F.sum(c).alias(f"sum_{c}") for c in columns])


def conditional_counts(df: DataFrame, **tests: Column) -> DataFrame:
    """All cards of a dashboard in one scan."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])


def workload(people: DataFrame, work: DataFrame, id_col: str, key: str, open_: Column) -> DataFrame:
    """Open items per person; people without any stay with 0."""
    busy = work.where(open_).groupBy(key).agg(F.count("*").alias("n"))
    return people.join(busy, people[id_col] == busy[key], "left").select(people["*"], F.coalesce("n", F.lit(0)).alias("open_items"))


def overdue(df: DataFrame, ts: str, as_of: str, hours: tuple[int, ...] = (4, 8)) -> DataFrame:
    """Counts of items older than each limit; the lower limit includes the higher."""
    return df.agg(*[F.count_if(F.col(ts) < F.expr(f"timestamp_ntz'{as_of}' - interval {h} hours")).alias(f"over_{h}h") for h in hours])


def decision_fold(verify: Column, failed: Column) -> Column:
    """TO_VERIFY before AUTO_FAIL before AUTO_PASS."""
    return F.when(verify > 0, "TO_VERIFY").when(failed > 0, "AUTO_FAIL").otherwise("AUTO_PASS")


def batch_fold(df: DataFrame, batch: str, error: Column, auto_pass: Column) -> DataFrame:
    """ERROR if every file failed to process, COMPLETED if every file passed, else REVIEW_PENDING."""
    out = df.groupBy(batch).agg(F.count("*").alias("files"), F.count_if(error).alias("e"), F.count_if(auto_pass).alias("p"))
    return out.select(batch, "files", F.when(F.col("e") == F.col("files"), "ERROR").when(F.col("p") == F.col("files"), "COMPLETED").otherwise("REVIEW_PENDING").alias("batch_status"))


def progress_counts(df: DataFrame, key: str, needs: Column, pending: Column) -> DataFrame:
    """Rows, rows to verify and rows still pending per key."""
    return df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(needs).alias("to_verify"), F.count_if(needs & pending).alias("pending"))


def status_counts(df: DataFrame, key: str, status: str, exact_case: bool = True) -> DataFrame:
    """Rows per key and status. Case matters unless told otherwise: mixed spellings are groups of their own."""
    return df.groupBy(key, (F.col(status) if exact_case else F.lower(status)).alias("status")).agg(F.count("*").alias("n"))


def status_pivot(df: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """A column of counts per status value."""
    return df.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.lower(status) == v.lower()).alias(f"n_{v.lower()}") for v in values])


def final_decision(df: DataFrame, key: str, verified: Column) -> DataFrame:
    """FAIL where a reviewer rejected any item; open items (null) do not count."""
    return df.groupBy(key).agg(F.when(F.coalesce(F.bool_or(~verified), F.lit(False)), "FAIL").otherwise("PASS").alias("final_decision"))


def action_items(df: DataFrame, key: str, rule: str, status: str, wanted: list[str]) -> DataFrame:
    """Per document the rules that ask for action, in rule order."""
    hit = df.where(F.lower(status).isin([w.lower() for w in wanted]))
    return hit.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.col(rule).cast("string"))), ",").alias("items"), F.count("*").alias("n"))


def most_frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """The mode per key; ties go to the smaller value."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"), F.max("n").alias("n"))


def summary(df: DataFrame, value: str, hit: Column) -> DataFrame:
    """n, mean, least, most and hit rate; all null-safe."""
    return df.agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(hit.cast("double")), 4).alias("hit_rate"))


def half_trend(df: DataFrame, key: str, order: list[str], value: str, at_least: int = 10, band: float = 2.0) -> DataFrame:
    """Mean of the earlier half against the later half of each key's rows: improving, declining or stable."""
    w = Window.partitionBy(key)
    ranked = df.select(key, value, F.row_number().over(w.orderBy(*order)).alias("r"), F.count("*").over(w).alias("n"))
    early = F.col("r") <= F.floor(F.col("n") / 2)
    halves = ranked.groupBy(key).agg(F.max("n").alias("n"), F.avg(value).alias("mean"), F.avg(F.when(early, F.col(value))).alias("a"), F.avg(F.when(~early, F.col(value))).alias("b"))
    trend = F.when(F.col("n") < at_least, "insufficient").when(F.col("b") - F.col("a") > band, "improving").when(F.col("a") - F.col("b") > band, "declining").otherwise("stable")
    level = F.when(F.col("mean") >= 85, "high").when(F.col("mean") >= 70, "medium").otherwise("low")
    return halves.select(key, "n", F.round("mean", 3).alias("mean"), level.alias("level"), trend.alias("trend"))


def map_statistics(values: Column) -> dict[str, Column]:
    """Mean, least, count below 70 and size of a map's values."""
    v = F.map_values(values)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(v).cast("double"), F.lit(0.0))
    return {"mean": mean, "least": F.array_min(v), "low": F.size(F.filter(v, lambda x: x < 70.0)), "size": F.size(v)}


def first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; the order must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def category_listing(df: DataFrame, rule_id: str, active: Column) -> DataFrame:
    """Rules and active rules per category, the part of the id before the dash."""
    return df.groupBy(F.substring_index(rule_id, "-", 1).alias("category")).agg(F.count("*").alias("rules"), F.count_if(active).alias("active"))


def weighted_score(df: DataFrame, category: str, status: str) -> DataFrame:
    """Passed counts 1, skipped and partial one half; a label from 80 and 50 percent."""
    s = F.lower(status)
    w = F.when(s == "passed", 1.0).when(s.isin("skipped", "partial"), 0.5).otherwise(0.0)
    pct = 100.0 * F.avg(w)
    return df.groupBy(category).agg(F.round(pct, 2).alias("score"), F.when(pct >= 80, "good").when(pct >= 50, "fair").otherwise("poor").alias("label"))


def on_day(ts: Column, as_of: str) -> Column:
    """Whether a time lies on the as-of time's calendar day; null is on no day."""
    return F.coalesce(F.to_date(ts) == F.to_date(F.expr(f"timestamp_ntz'{as_of}'")), F.lit(False))


def version_stats(df: DataFrame, version: str, value: str) -> DataFrame:
    """Mean and rows per version, in the versions' order; rows without a version are left out."""
    return df.where(F.col(version).isNotNull()).groupBy(version).agg(F.avg(value).alias("avg_value"), F.count("*").alias("n")).orderBy(version)


def page_stats(df: DataFrame, order: list[Column], page: int, size: int, **tests: Column) -> DataFrame:
    """Cards over one page of an ordered list (pages count from 0): its rows, and those of each test."""
    return df.orderBy(*order).offset(page * size).limit(size).agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in tests.items()])


def session_counters(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Sessions with what their actions add: files processed and failed, corrections, last activity, status.

    ``actions``: session_token, ts, action (FILE_OK, FILE_FAILED, CORRECTION or ACTIVITY). Files and activity move the last
    activity forward, and activity makes a session ACTIVE; corrections do neither. Actions of unknown sessions are dropped.
    """
    is_ = lambda *names: F.col("action").isin(*names)
    n = actions.groupBy("session_token").agg(
        F.count_if(is_("FILE_OK")).alias("_ok"), F.count_if(is_("FILE_FAILED")).alias("_bad"), F.count_if(is_("CORRECTION")).alias("_fixed"),
        F.max(F.when(is_("FILE_OK", "FILE_FAILED", "ACTIVITY"), F.col("ts"))).alias("_last"), F.max(F.coalesce(is_("ACTIVITY"), F.lit(False))).alias("_active"),
    )
    plus = lambda a, b: (F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))).cast("long")
    both = sessions.join(n, "session_token", "left")
    new = {"files_processed": plus("files_processed", "_ok"), "files_failed": plus("files_failed", "_bad"), "corrections_made": plus("corrections_made", "_fixed"), "last_active_at": F.greatest("last_active_at", "_last"), "status": F.when(F.col("_active"), "ACTIVE").otherwise(F.col("status"))}
    return both.withColumns(new).select(*sessions.columns)
