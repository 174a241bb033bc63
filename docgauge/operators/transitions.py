"""Status changes as pure table transitions: a table and an as-of time in, the new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns take new values on the rows that ``where`` selects; null tests select nothing."""
    hit = F.coalesce(where, F.lit(False))
    return df.withColumns({n: F.when(hit, v).otherwise(F.col(n)) if n in df.columns else F.when(hit, v) for n, v in values.items()})


def claim(df: DataFrame, as_of: Column) -> DataFrame:
    """A batch enters processing unless it is there or done; its error is cleared and its version counts up."""
    return changed(df, F.col("status").isin("UPLOADED", "VALIDATING", "ERROR"), status=F.lit("QC_PROCESSING"), error_message=F.lit(None).cast("string"), version=F.col("version") + 1, updated_at=as_of)


def stop(df: DataFrame, as_of: Column, message: str) -> DataFrame:
    return changed(df, F.col("status") == "QC_PROCESSING", status=F.lit("UPLOADED"), error_message=F.lit(message), updated_at=as_of)


def heartbeat(df: DataFrame, as_of: Column) -> DataFrame:
    return changed(df, F.col("status") == "QC_PROCESSING", updated_at=as_of)


def assign(df: DataFrame, reviewer: Column, as_of: Column) -> DataFrame:
    """Any batch that is not being processed goes to the reviewer, finished ones too."""
    return changed(df, F.col("status") != "QC_PROCESSING", assigned_reviewer_id=reviewer, status=F.lit("REVIEW_PENDING"), updated_at=as_of)


def collapsed(df: DataFrame, column: str, renames: dict[str, list[str]]) -> DataFrame:
    """Several old values become one new value."""
    out = F.col(column)
    for new, old in renames.items():
        out = F.when(F.col(column).isin(old), F.lit(new)).otherwise(out)
    return df.withColumn(column, out)


def deleted(df: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Rows whose key is not among ``gone``: a cascade applies it table by table."""
    return df.join(gone.select(F.col(gone_key or key).alias(key)), key, "left_anti")


def counters(results: DataFrame, items: DataFrame, key: str, faithful: bool = True) -> DataFrame:
    """Recomputed status counters of each result.

    ``faithful`` keeps the service's behaviour that of two spellings of a status only one group counts (the later one in
    byte order here); otherwise spellings are added up.
    """
    by = items.groupBy(key, "status").agg(F.count("*").alias("n")).withColumn("s", F.lower("status"))
    one = by.groupBy(key, "s").agg((F.max_by("n", "status") if faithful else F.sum("n")).alias("n"))
    wide = one.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("s") == s, F.col("n"))), F.lit(0)).alias(f"{s}_count") for s in ("pass", "fail", "verify", "manual_pass")])
    return results.join(wide, key, "left")


def idle(df: DataFrame, as_of: Column, minutes: int = 15) -> DataFrame:
    """Active sessions without activity for so long are idle; one that never acted stays active."""
    return changed(df, (F.col("status") == "ACTIVE") & (F.col("last_active_at") < as_of - F.expr(f"interval {minutes} minutes")), status=F.lit("IDLE"))


def reconciled(df: DataFrame, as_of: Column, healthy: bool, retry: int = 15, give_up: int = 90) -> DataFrame:
    """What becomes of batches stuck in processing: retried where the worker is well, errors after ``give_up`` minutes."""
    age = lambda m: F.col("updated_at") < as_of - F.expr(f"interval {m} minutes")
    stuck = F.col("status") == "QC_PROCESSING"
    action = F.when(stuck & age(give_up), "ERROR").when(stuck & age(retry) & F.lit(healthy), "RETRY").when(stuck & age(retry), "WAIT").otherwise("NONE")
    return df.withColumn("action", action).withColumn("status", F.when(F.col("action") == "ERROR", "ERROR").when(F.col("action") == "RETRY", "UPLOADED").otherwise(F.col("status")))


def live(df: DataFrame, key: str, ts: str, as_of: Column, seconds: int) -> DataFrame:
    """Last state per key with its first time, without what has expired."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), ts).alias("s"), F.min(ts).alias("started_at"))
    return last.select("s.*", "started_at").where(F.col(ts) >= as_of - F.expr(f"interval {seconds} seconds"))
