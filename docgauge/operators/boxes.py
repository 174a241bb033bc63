"""Greedy choices among boxes of a page: go through them by priority, keep what is near to none that was kept.

A page of at most ``MOST`` boxes is one loop over its sorted boxes, in one aggregation. Boxes of larger pages meet only
where they share a cell of a grid: one that comes first among the undecided of all its cells is kept, the undecided ones
near to it go, and so on until none is undecided. That is the same as one loop over the page, but a round is an
aggregation and an equi-join on cells, so a page may hold any number of boxes. A cell adds one kept box a round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgauge.operators.evidence import overlap
from docgauge.sources.scratch import dropped, shared_folder, written

#: Parts that the undecided boxes of a crowded cell are dealt to.
SALTS = 8
#: Boxes of the largest page that is gone through in one loop.
MOST = 256


def greedy(boxes: DataFrame, page: list[str], id_col: str, priority: list[Column], cells: Column, near: Callable[[Column, Column], Column]) -> DataFrame:
    """``boxes`` with ``kept``. ``priority`` are ascending keys, ties go by ``id_col``, which is unique in a page.

    ``cells`` is an array of grid cells; boxes that are ``near`` (of two structs of all columns) must share one. One
    without cells is near to none. Pages are groups of equal ``page`` columns, which may be null.
    """
    by = [f"_p{i}" for i in range(len(page))]
    place = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(n) for c, n in zip(page, by, strict=True)]
    rank = F.struct(*[k.alias(f"k{i}") for i, k in enumerate([*priority, F.col(id_col)])])
    # a table, as neither the boxes nor the row numbers may change between rounds
    base = written(boxes.select(F.monotonically_increasing_id().alias("_row"), *place, rank.alias("_rank"), cells.alias("_cells"), F.struct(*boxes.columns).alias("_box")))
    crowded = written(base.groupBy(*by).count().where(F.col("count") > MOST).select(*by))
    if not crowded.limit(1).count():
        return looped(base, by, near)
    return looped(base.join(crowded, by, "left_anti"), by, near).unionByName(by_rounds(base.join(crowded, by, "left_semi"), by, near))


def looped(base: DataFrame, by: list[str], near: Callable[[Column, Column], Column]) -> DataFrame:
    """``greedy`` in one loop a page, over rows (_rank, _box) whose pages are small."""
    pages = base.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_rank", "_box"))).alias("_all"))
    row = lambda b, kept: F.struct(b["_box"].alias("_box"), kept.alias("kept"))
    none = F.filter(F.transform("_all", lambda b: row(b, F.lit(True))), lambda r: F.lit(False))
    taken = lambda seen, b: F.exists(seen, lambda r: r["kept"] & F.coalesce(near(b["_box"], r["_box"]), F.lit(False)))
    every = F.aggregate("_all", none, lambda seen, b: F.concat(seen, F.array(row(b, ~taken(seen, b)))))
    return pages.select(F.inline(every)).select("_box.*", "kept")


def by_rounds(base: DataFrame, by: list[str], near: Callable[[Column, Column], Column]) -> DataFrame:
    """``greedy`` by rounds over all pages at once, over rows (_row, _rank, _cells, _box). No side of a join is broadcast."""
    base = written(base)
    path = shared_folder(base.sparkSession)
    met_by_cells = F.coalesce(F.size("_cells") > 0, F.lit(False))
    base.where(~met_by_cells).select("_row").write.parquet(path)
    open_ = written(base.where(met_by_cells))
    while open_.limit(1).count():
        spread = open_.select("_row", *by, "_rank", "_box", F.explode("_cells").alias("_cell"))
        first = spread.groupBy(*by, "_cell").agg(F.min("_rank").alias("_first"))
        heads = first.groupBy(*by, F.col("_first").alias("_rank")).agg(F.count("*").alias("_cells_won"))
        new = written(open_.join(heads.hint("merge"), [*by, "_rank"]).where(F.size("_cells") == F.col("_cells_won")).select("_row", *by, "_box", "_cells"))
        won = new.select(*by, F.explode("_cells").alias("_cell"), F.col("_box").alias("_head"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt"))
        met = spread.withColumn("_salt", F.pmod(F.hash("_row"), F.lit(SALTS)).cast("int")).join(won.hint("merge"), [*by, "_cell", "_salt"]).where(near(F.col("_box"), F.col("_head")))
        gone = new.select("_row").unionByName(met.select("_row")).distinct()
        left = written(open_.join(gone.hint("merge"), "_row", "left_anti"))
        new.select("_row").write.mode("append").parquet(path)  # one table however many rounds
        dropped(new)
        dropped(open_)
        open_ = left
    kept = base.sparkSession.read.schema("_row long").parquet(path).withColumn("kept", F.lit(True))
    return base.join(kept.hint("merge"), "_row", "left").select("_box.*", F.coalesce("kept", F.lit(False)).alias("kept"))


def covered(size: float) -> Column:
    """Cells of a square grid that a box (x, y, w, h) touches."""
    span = lambda a, w: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + F.col(w)) / size))
    return F.flatten(F.transform(span("x", "w"), lambda i: F.transform(span("y", "h"), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def suppressed(boxes: DataFrame, page: list[str], id_col: str, scores: list[str], threshold: float = 0.3, cell: float = 64.0) -> DataFrame:
    """Non-maximum suppression: by descending scores, a box goes if it overlaps a kept one by more than ``threshold``.

    Overlap is intersection over union of (x, y, w, h). Null scores come last.
    """
    low = F.lit(float("-inf"))
    priority = [-F.coalesce(F.col(s).cast("double"), low) for s in scores]
    return greedy(boxes, page, id_col, priority, covered(cell), lambda a, b: overlap(a, b) > threshold)


def distinct_boxes(boxes: DataFrame, page: list[str], id_col: str, apart: float = 15.0) -> DataFrame:
    """In reading order by x * 10000 + y, a box goes if a kept one begins less than ``apart`` away in both directions.

    A box lies in the cells of ``apart`` pixels that begin at its corner and behind it, so two that are near share one.
    """
    two = lambda c: F.array(F.floor(F.col(c) / apart), F.floor(F.col(c) / apart) + 1)
    cells = F.flatten(F.transform(two("x"), lambda i: F.transform(two("y"), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    near = lambda a, b: (F.abs(a["x"] - b["x"]) < apart) & (F.abs(a["y"] - b["y"]) < apart)
    return greedy(boxes, page, id_col, [F.col("x") * 10000 + F.col("y")], cells, near)
