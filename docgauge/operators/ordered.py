"""Window-shaped logic: offsets, neighbours, frames, as-of lookups and spatial neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_starts(pages: DataFrame, doc: str, page: str, text: str, gap: int = 2) -> DataFrame:
    """Start offset of each page in the joined text of its document."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)))


def page_of(positions: DataFrame, starts: DataFrame, doc: str, pos: str, page: str) -> DataFrame:
    """As-of lookup: the last page that starts at or before a position.

    Positions and page starts of a document are merged into one ordered stream and the page is carried forward, so the
    cost is one sort per document whatever the number of pages.
    """
    marks = starts.select(doc, F.col("start").alias("at"), F.lit(0).alias("kind"), F.col(page).alias("found"), F.lit(None).cast(positions.schema[pos].dataType).alias(pos))
    asks = positions.select(doc, F.col(pos).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema[page].dataType).alias("found"), pos)
    w = Window.partitionBy(doc).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("found", F.last("found", ignorenulls=True).over(w)).where("kind = 1").select(doc, pos, F.col("found").alias(page))


def next_value(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lead(column).over(Window.partitionBy(*keys).orderBy(*order)))


def previous_value(df: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def frame_hit(df: DataFrame, key: str, order: str, value: str, size: int, target: float, tolerance: float) -> DataFrame:
    """First run of ``size`` consecutive values whose sum is within tolerance of the target; short frames don't count."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, size - 1)
    framed = df.select(key, order, F.sum(value).over(w).alias("total"), F.count(value).over(w).alias("n"))
    hit = framed.where((F.col("n") == size) & (F.abs(F.col("total") - target) <= tolerance))
    return hit.groupBy(key).agg(F.min_by(F.struct(order, "total"), order).alias("h")).select(key, F.col(f"h.{order}").alias("start"), F.col("h.total").alias("total"))


def carried_forward(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Blank cells take the last value above them."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def row_clusters(words: DataFrame, keys: list[str], y: str, height: str, tolerance: float = 0.014) -> DataFrame:
    """Line number of each word: words join the open line while their middle is within tolerance of its running mean.

    The running mean depends on the words already taken, so a page is folded in one group; pages are small by nature.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(_m=g[y] + g[height] / 2).sort_values(["_m"], kind="stable")
        line, mean, n, out = -1, 0.0, 0, []
        for m in g["_m"]:
            if n and abs(m - mean) <= tolerance:
                mean, n = (mean * n + m) / (n + 1), n + 1
            else:
                line, mean, n = line + 1, m, 1
            out.append(line)
        return g.drop(columns="_m").assign(line=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields) + ", line int"
    return words.groupBy(*keys).applyInPandas(fold, schema)


def inside(words: DataFrame, x: float, y: float, right: float, bottom: float) -> DataFrame:
    """Words that lie in a box."""
    return words.where((F.col("bbox_x") >= x) & (F.col("bbox_y") >= y) & (F.col("bbox_x") + F.col("bbox_w") <= right) & (F.col("bbox_y") + F.col("bbox_h") <= bottom))


def label_sequences(words: DataFrame, keys: list[str], label: list[str], spread: float = 0.02) -> DataFrame:
    """Places where consecutive words read as the label on one line: keys, box of the label."""
    w = Window.partitionBy(*keys).orderBy("bbox_y", "bbox_x")
    n = len(label)
    part = words.select(*keys, "bbox_y", "bbox_x", F.struct("text", "bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("t"))
    for i in range(n):
        part = part.withColumn(f"t{i}", F.lead("t", i).over(w))
    test = F.lit(True)
    for i, token in enumerate(label):
        test = test & (F.lower(F.regexp_replace(F.col(f"t{i}.text"), "[:.]+$", "")) == token.lower())
    ys = F.array(*[F.col(f"t{i}.bbox_y") for i in range(n)])
    hit = part.where(F.coalesce(test, F.lit(False)) & (F.array_max(ys) - F.array_min(ys) <= spread))
    return hit.select(*keys, F.col("t0.bbox_x").alias("x"), F.array_min(ys).alias("y"), (F.col(f"t{n - 1}.bbox_x") + F.col(f"t{n - 1}.bbox_w")).alias("right"), F.col("t0.bbox_h").alias("h"))


def spatial_value(words: DataFrame, keys: list[str], label: list[str], reach_right: float = 0.42, reach_below: float = 0.12) -> DataFrame:
    """Text to the right of a label on its line, else of the nearest line below within its column."""
    labels = label_sequences(words, keys, label)
    near = labels.join(words, keys)
    same = (F.abs(F.col("bbox_y") - F.col("y")) <= 0.02) & (F.col("bbox_x") >= F.col("right")) & (F.col("bbox_x") - F.col("right") <= reach_right)
    below = (F.col("bbox_y") > F.col("y") + 0.02) & (F.col("bbox_y") - F.col("y") <= reach_below) & (F.col("bbox_x") >= F.col("x") - 0.02) & (F.col("bbox_x") <= F.col("right") + 0.2)
    found = near.where(same | below).withColumn("rank", F.when(same, 0.0).otherwise(F.round(F.col("bbox_y"), 2)))
    first = found.withColumn("best", F.min("rank").over(Window.partitionBy(*keys, "x", "y"))).where(F.col("rank") == F.col("best"))
    lines = first.groupBy(*keys, "x", "y").agg(F.array_sort(F.collect_list(F.struct("bbox_x", "bbox_y", "text"))).alias("ws"))
    return lines.select(*keys, F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("value"), F.array_min(F.transform("ws", lambda w: w["bbox_x"])).alias("bbox_x"), F.array_min(F.transform("ws", lambda w: w["bbox_y"])).alias("bbox_y"))


def merged_box(boxes: Column) -> Column:
    """Smallest box around an array of (x, y, w, h) boxes, four decimals."""
    x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
    right, bottom = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
    return F.struct(F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(right - x, 4).alias("w"), F.round(bottom - y, 4).alias("h"))


# fixed values: tokens that mark a box
MARKS = ["x", "X", "><", "✓", "✔", "[X]", "[x]"]


def marked_labels(words: DataFrame, keys: list[str], labels: list[list[str]], reach: float = 0.08, spread: float = 0.02) -> DataFrame:
    """(keys, label): the label with a mark on its line, at most ``reach`` to its left; the first label of the list wins."""
    marks = words.where(F.col("text").isin(MARKS)).select(*keys, (F.col("bbox_x") + F.col("bbox_w")).alias("_end"), F.col("bbox_y").alias("_y"))
    out = None
    for rank, label in enumerate(labels):
        spots = label_sequences(words, keys, label, spread).select(*keys, "x", "y", F.lit(rank).alias("_rank"), F.lit(" ".join(label)).alias("label"))
        out = spots if out is None else out.unionByName(spots)
    near = out.join(marks, keys).where((F.abs(F.col("_y") - F.col("y")) <= spread) & (F.col("_end") <= F.col("x")) & (F.col("x") - F.col("_end") <= reach))
    return near.groupBy(*keys).agg(F.min_by("label", "_rank").alias("label"))
