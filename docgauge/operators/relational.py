"""Finders, searches, paging, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.text import contains_folded


def find(df: DataFrame, **equal: object) -> DataFrame:
    """Rows where every named column equals its value; None asks for null. Reaches the scan as pushed filters."""
    for name, value in equal.items():
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return df


def search(df: DataFrame, columns: list[str], needle: str | None, **equal: object) -> DataFrame:
    """Optional exact filters and an optional case-insensitive substring over several columns."""
    df = find(df, **{k: v for k, v in equal.items() if v is not None})
    if not needle:
        return df
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(contains_folded(F.col(c).cast("string"), needle), F.lit(False))
    return df.where(test)


def between(df: DataFrame, ts: str, low: str, high: str) -> DataFrame:
    return df.where(F.col(ts).between(F.expr(f"timestamp_ntz'{low}'"), F.expr(f"timestamp_ntz'{high}'")))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) under a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def with_count(parent: DataFrame, child: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Children per parent, 0 included: one pre-aggregation and a left join instead of a subquery per row."""
    n = child.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
    return parent.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def existing(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_semi")


def missing(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of the same key; the rest is kept."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def pending_queue(df: DataFrame, id_col: str, failed: str, verify: str, ts: str) -> DataFrame:
    """Distinct items by failed and verify counts, most first, then oldest."""
    return df.dropDuplicates([id_col]).orderBy(F.desc(failed), F.desc(verify), F.asc_nulls_last(ts), F.asc(id_col))


def urgent_first(df: DataFrame, urgent: Column, order: list[Column]) -> DataFrame:
    return df.orderBy(urgent.desc(), *order)


def later_copies(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Flags every copy of a key behind its first arrival."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def recommended(items: DataFrame, people: DataFrame, item: str, kind: str, own: str, order: list[Column], n: int) -> DataFrame:
    """The ``n`` best people per item, those of the item's kind (``kind`` equals the person's ``own``) first.

    An item meets the ``n`` best of its own kind by an equi-join, and as many of all people to fill up from; no other
    person can rank. People without a kind come after those of another one.
    """
    place = F.row_number().over(Window.partitionBy(own).orderBy(*order))
    best = people.where(F.col(own).isNotNull()).withColumn("rank", place).where(F.col("rank") <= n).drop("rank")
    mine = items.join(best, F.col(kind) == F.col(own))
    first = lambda *by: people.orderBy(*by).limit(n).agg(F.collect_list(F.struct(*people.columns))).scalar()
    fill = F.when(F.col(kind).isNull(), first(*order)).otherwise(first(F.col(own).isNull(), *order))
    rest = items.withColumn("person", F.explode(fill)).select(*items.columns, "person.*")
    same = F.col(kind) == F.col(own)
    both = mine.unionByName(rest.where(~F.coalesce(same, F.lit(False)))).withColumn("same", same)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(item).orderBy(F.desc("same"), *order))).where(F.col("rank") <= n)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def set_table(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values with where they occur: both, left or right. One full join answers union, difference, intersection."""
    a, b = left.select(column).distinct().withColumn("l", F.lit(True)), right.select(column).distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left").otherwise("right")
    return a.join(b, column, "full").select(column, side.alias("side"))


def nested(parent: DataFrame, child: DataFrame, key: str, child_key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children as a sorted array of structs, empty where there are none. Children of a key are few by nature."""
    held = child.groupBy(F.col(child_key).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(held.schema[name].dataType)
    return parent.join(held, key, "left").withColumn(name, F.coalesce(name, empty))


def pending(df: DataFrame, key: str, open_: Column) -> DataFrame:
    """Per key whether any row is still open; null tests are not."""
    return df.groupBy(key).agg(F.coalesce(F.bool_or(F.coalesce(open_, F.lit(False))), F.lit(False)).alias("pending"))
