"""The prefix trie of all conversations, as a Cartesian tree over the LCP array of the sorted conversations.

Conversations are sorted by their sequences of turns; between neighbours stands the length of their common prefix. The
members of a trie node are a run of neighbours, and the run around a common prefix ends where the nearest smaller ones
stand on either side. Those are found per block of ranks with a stack; what a block leaves open asks the block minima,
which are an array of the same kind, a block's length shorter, and so on upwards. Equal runs merge into one node, the
depths between a node and its parent are filled in, and a node's figures are differences of running sums over ranks.

Turns enter as SHA-256 of role and text. A conversation, however long, is cut into blocks of turns, and a table is
numbered by range partitions, so no step gathers a conversation, a run or a group of copies in one task; the exception
is a group's checksum, whose ids one task streams in order, as SHA-256 has to, holding none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgauge.llm._common import Batches, forget, stored, trimmed

#: Ranks, and turns of one conversation, in a block.
BLOCK = 1024
Keep = Callable[[DataFrame], DataFrame]


def numbered(df: DataFrame, key: str, order: list[Column], keep: Keep, drop: tuple[str, ...] = (), weights: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in the order of ``key`` (not null) and ``order``, numbered whatever the size of a key's group.

    Adds nth (place in the order, from 0), start (nth of the first row of the key) and group (number of the key), and
    per weight w (not negative) upto_w, its sum over rows up to this one, and before_w, that before the key's first row.
    Rows are range-partitioned and stored without ``drop``; a group may span partitions, of which one row each is
    combined. Ties in the order are numbered arbitrarily but once.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("at", F.monotonically_increasing_id())
    placed = keep(placed.drop(*drop)).withColumn("part", F.shiftright("at", 33))
    run = Window.partitionBy("part").orderBy("at")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("row", F.row_number().over(run)).withColumn("new", (F.col("row") == 1) | ~F.col(key).eqNullSafe(F.lag(key).over(run)))
    for w in weights:
        rows = rows.withColumn(f"upto_{w}", F.sum(w).over(upto))
    first = lambda v: F.when(F.col("new"), v)
    own = {"start": F.col("row"), **{f"before_{w}": F.col(f"upto_{w}") - F.col(w) for w in weights}}
    ends = rows.groupBy("part").agg(
        F.count("*").alias("n"), F.sum(F.col("new").cast("long")).alias("groups"), F.min_by(key, "at").alias("head"), F.max_by(key, "at").alias("foot"),
        *[F.max(first(v)).alias(f"last_{c}") for c, v in own.items()], *[F.sum(w).alias(f"sum_{w}") for w in weights],
    )
    by, past = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    none = F.lit(0).cast("long")
    ends = ends.withColumn("goes_on", F.coalesce(F.lag("foot").over(by) == F.col("head"), F.lit(False)))
    ends = ends.withColumn("offset_start", F.coalesce(F.sum("n").over(past), none))
    for w in weights:
        ends = ends.withColumn(f"offset_before_{w}", F.coalesce(F.sum(f"sum_{w}").over(past), none))
    starts = ~F.col("goes_on") | (F.col("groups") > 1)
    ends = ends.withColumn("offset_group", F.coalesce(F.sum(F.col("groups") - F.col("goes_on").cast("long")).over(past), none) - F.col("goes_on").cast("long"))
    ends = ends.select("part", "goes_on", "offset_group", *[f"offset_{c}" for c in own], *[F.max(F.when(starts, F.col(f"offset_{c}") + F.col(f"last_{c}"))).over(past).alias(f"carried_{c}") for c in own])
    rows = rows.withColumn("nth_group", F.sum(F.col("new").cast("long")).over(upto))
    for c, v in own.items():
        rows = rows.withColumn(f"own_{c}", F.max(first(v)).over(upto))
    out = rows.join(F.broadcast(ends), "part")  # as many rows as range partitions
    carried = F.col("goes_on") & (F.col("nth_group") == 1)
    whole = {c: F.when(carried, F.col(f"carried_{c}")).otherwise(F.col(f"offset_{c}") + F.col(f"own_{c}")) for c in own}
    whole["start"] = whole["start"] - 1
    return out.select(
        *placed.drop("at", "part").columns, (F.col("offset_start") + F.col("row") - 1).alias("nth"), (F.col("offset_group") + F.col("nth_group") - 1).alias("group"),
        *[v.alias(c) for c, v in whole.items()], *[(F.col(f"offset_before_{w}") + F.col(f"upto_{w}")).alias(f"upto_{w}") for w in weights],
    )


def block_of(c: str | Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / BLOCK).cast("long")


# ---- rebuilt conversations


def rebuilt(df: DataFrame, keep: Keep, family: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, pos from 1, token, size, total of sizes so far), and conversations (conv)."""
    own = numbered(df, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], keep, ("turn", "role", "text"))
    own = keep(own.select("conv", "token", "size", (F.col("nth") - F.col("start") + 1).alias("pos")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % spread
    convs = keep(own.select("conv").distinct())
    heads = own.where(F.col("pos") < spread).select(F.col("conv").alias("base"), "pos", "token", "size")
    lead = convs.withColumn("base", F.col("conv") - F.col("conv") % family).join(heads, "base").where(F.col("pos") <= h)  # a base has at most 2 * family - 1 followers
    turns = lead.select("conv", F.col("pos").alias("place"), "token", "size").unionByName(own.where(F.col("pos") > h).select("conv", (F.col("pos") + spread).alias("place"), "token", "size"))
    turns = numbered(turns, "conv", [F.col("place")], keep, ("place",), ("size",))
    return turns.select("conv", (F.col("nth") - F.col("start") + 1).alias("pos"), "token", "size", (F.col("upto_size") - F.col("before_size")).alias("total")), convs


def in_blocks(turns: DataFrame) -> DataFrame:
    """Blocks of turns (conv, block, items, totals, base): base is the total before the block."""
    grouped = turns.groupBy("conv", block_of(F.col("pos") - 1).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "token", "total", "size"))).alias("t"))
    return grouped.select("conv", "block", F.col("t.token").alias("items"), F.col("t.total").alias("totals"), (F.col("t")[0]["total"] - F.col("t")[0]["size"]).alias("base"))


def ranked(blocks: DataFrame, convs: DataFrame, keep: Keep) -> DataFrame:
    """(conv, rank, class): ranks by sequence, then id; class is the rank of the first equal sequence.

    Sequences of several blocks are compared by their blocks' numbers in sorted order, level by level.
    """
    level = blocks.select("conv", "block", "items")
    while level.where("block > 0").limit(1).count():
        names = numbered(level, "items", [F.col("conv"), F.col("block")], keep, (), ())
        level = keep(names.groupBy("conv", block_of("block").alias("up")).agg(F.sort_array(F.collect_list(F.struct("block", "group"))).alias("t")).select("conv", F.col("up").alias("block"), F.col("t.group").alias("items")))
    nothing = F.array().cast(level.schema["items"].dataType)
    tops = convs.join(level.select("conv", "items"), "conv", "left").withColumn("items", F.coalesce("items", nothing))
    return keep(numbered(tops, "items", [F.col("conv")], keep, (), ()).select("conv", F.col("nth").alias("rank"), F.col("start").alias("class")))


def with_prefixes(blocks: DataFrame, ranks: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Blocks by rank, and per rank: conv, class, len, lcp with the rank before (-1 at rank 0), and the size of that prefix."""
    sizes = blocks.groupBy("conv").agg(F.sum(F.size("items")).alias("len"), F.count("*").alias("blocks"))
    seqs = keep(ranks.join(sizes, "conv", "left").select("conv", "rank", "class", F.coalesce("len", F.lit(0)).cast("long").alias("len"), F.coalesce("blocks", F.lit(0)).alias("blocks")))
    spots = seqs.where("blocks > 0").select("conv", "rank", F.col("blocks").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    mine = keep(blocks.join(spots, ["conv", "block"]).drop("conv"))
    past = mine.select((F.col("rank") + 1).alias("rank"), "block", F.col("items").alias("others"))
    differs = F.array_position(F.zip_with("items", "others", lambda x, y: x.eqNullSafe(y)), False)
    k = F.when(F.col("others").isNull(), 0).when(differs > 0, differs - 1).when(F.col("block") == F.col("of") - 1, F.size("items")).cast("int")
    size = F.when(k > 0, F.element_at("totals", k)).otherwise(F.col("base"))
    found = mine.join(past, ["rank", "block"], "left").select("rank", F.when(k.isNotNull(), F.struct((F.col("block") * BLOCK + k).alias("lcp"), size.alias("shared"))).alias("f")).groupBy("rank").agg(F.min("f").alias("f"))
    top = F.col("rank") == 0
    none = F.lit(0).cast("long")
    return mine, seqs.drop("blocks").join(found, "rank", "left").select("rank", "conv", "class", "len", F.when(top, F.lit(-1)).otherwise(F.coalesce("f.lcp", none)).cast("long").alias("lcp"), F.when(top, none).otherwise(F.coalesce("f.shared", none)).alias("shared"))


# ---- nearest smaller values and least values, by blocks


def smaller_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """Positions of the nearest smaller values on both sides inside one block, -1 where there is none; by a stack."""
    block = block.sort_values("pos")
    pos, value = block["pos"].to_numpy(), block["value"].to_numpy()
    lo, hi, stack = np.full(len(pos), -1), np.full(len(pos), -1), []
    for i, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            hi[stack.pop()] = pos[i]
        if stack:  # an equal one shares what is left of it
            lo[i] = lo[stack[-1]] if value[stack[-1]] == v else pos[stack[-1]]
        stack.append(i)
    out = pd.DataFrame({"block": block["block"], "pos": pos, "value": value, "lo": lo, "hi": hi})
    return out[out["value"] >= 0]


def nearest(asked: pd.DataFrame, values: pd.DataFrame, inside: bool) -> pd.DataFrame:
    """Per question (pos, v, side): the last (side 0) or first (side 1) position of a value below v, -1 if none.

    Only positions before or after ``pos`` count, or all where ``inside``.
    """
    values = values.sort_values("pos")
    pos, value = values["pos"].to_numpy(), values["value"].to_numpy()
    at = []
    for p, v, side in zip(asked["pos"], asked["v"], asked["side"], strict=True):
        i = np.searchsorted(pos, p)
        hits = pos[value < v] if inside else pos[:i][value[:i] < v] if side == 0 else pos[i + 1 :][value[i + 1 :] < v]
        at.append(-1 if not len(hits) else hits[-1] if side == 0 else hits[0])
    return asked.assign(at=np.array(at, np.int64))[["pos", "v", "side", "at"]]


def beyond(level: DataFrame, asked: DataFrame, keep: Keep) -> DataFrame:
    """(block, v, side, at): the nearest position below v before or after a whole block of ``level`` (pos, value).

    Block minima are searched for the block that holds it, where need be by their own blocks' minima, and then the
    block. Questions are distinct per block, and joined back on the block, so no key holds more than a block's rows.
    """
    above = keep(level.groupBy(block_of("pos").alias("pos")).agg(F.min("value").alias("value")))
    schema = "pos long, v long, side int, at long"
    search = lambda a, v: nearest(a, v, False)
    inside = lambda a, v: nearest(a, v, True)
    near = keep(asked.select(F.col("block").alias("pos"), "v", "side").groupBy(block_of("pos")).cogroup(above.groupBy(block_of("pos"))).applyInPandas(search, schema))
    found, open_ = near.where("at >= 0"), near.where("at < 0")
    if open_.limit(1).count():
        farther = beyond(above, open_.select(block_of("pos").alias("block"), "v", "side").distinct(), keep)
        found = keep(found.unionByName(open_.drop("at").withColumn("block", block_of("pos")).join(farther, ["block", "v", "side"]).drop("block")))
    goals = found.select(F.col("at").alias("pos"), "v", "side").distinct()
    spots = goals.groupBy("pos").cogroup(level.groupBy(block_of("pos"))).applyInPandas(inside, schema)
    return keep(found.withColumnRenamed("pos", "block").withColumnRenamed("at", "pos").join(spots, ["pos", "v", "side"]).select("block", "v", "side", "at"))


def least(asked: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
    """Least value of each asked run (a, b) of one block, from a table of runs of powers of two."""
    values = values.sort_values("pos")
    start, table = values["pos"].iloc[0] if len(values) else 0, [values["value"].to_numpy()]
    while len(table[-1]) > 1 << (len(table) - 1):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    a, b = asked["a"].to_numpy() - start, asked["b"].to_numpy() - start
    power = np.log2(b - a + 1).astype(int)
    out = np.array([min(table[p][i], table[p][j - (1 << p) + 1]) for p, i, j in zip(power, a, b, strict=True)], np.int64)
    return asked.assign(least=out)[["block", "a", "b", "least"]]


def range_least(level: DataFrame, asked: DataFrame, keep: Keep) -> DataFrame:
    """(lo, hi, least): the least value of ``level`` (pos, value, no gaps) from lo to hi, for distinct (lo, hi).

    The ends of a run are answered in their blocks and the whole blocks between them by the block minima.
    """
    x, y = block_of("lo"), block_of("hi")
    piece = lambda block, a, b: F.struct(block.alias("block"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    ends = F.when(x == y, F.array(piece(x, F.col("lo"), F.col("hi")))).otherwise(F.array(piece(x, F.col("lo"), x * BLOCK + BLOCK - 1), piece(y, y * BLOCK, F.col("hi"))))
    pieces = keep(asked.select("lo", "hi", F.explode(ends).alias("p")).select("lo", "hi", "p.*"))
    told = pieces.select("block", "a", "b").distinct().groupBy("block").cogroup(level.groupBy(block_of("pos"))).applyInPandas(least, "block long, a long, b long, least long")
    out = pieces.join(told, ["block", "a", "b"]).select("lo", "hi", "least")
    middle = asked.where(y - x > 1).select("lo", "hi", (x + 1).alias("a"), (y - 1).alias("b"))
    if middle.limit(1).count():
        above = keep(level.groupBy(block_of("pos").alias("pos")).agg(F.min("value").alias("value")))
        runs = range_least(above, middle.select(F.col("a").alias("lo"), F.col("b").alias("hi")).distinct(), keep)
        out = out.unionByName(middle.join(runs.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "least"), ["a", "b"]).select("lo", "hi", "least"))
    return keep(out.groupBy("lo", "hi").agg(F.min("least").alias("least")))


# ---- the trie


def checksums(batches: Batches) -> Batches:
    """SHA-256 of each class's ids, from rows ordered by class and id; state goes on over batches, ids are not kept."""
    now, digest, out = None, None, []
    for batch in batches:
        for name, conv in zip(batch.column("class").to_pylist(), batch.column("conv").to_pylist(), strict=True):
            if name != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = name, hashlib.sha256(str(conv).encode())
            else:
                digest.update(f",{conv}".encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out])], names=["class", "ends"])
            out = []
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["class", "ends"])


def runs(seqs: DataFrame, count: int, keep: Keep) -> DataFrame:
    """(j, lcp, lo, hi) per rank j with a common prefix of any length: the nearest smaller ones on both sides."""
    level = keep(seqs.select(F.col("rank").alias("pos"), F.col("lcp").alias("value")).unionByName(seqs.sparkSession.createDataFrame([(count, -1)], "pos long, value long")))
    mine = keep(level.withColumn("block", block_of("pos")).groupBy("block").applyInPandas(smaller_in_block, "block long, pos long, value long, lo long, hi long"))
    sides = F.filter(F.array(F.when(F.col("lo") < 0, 0), F.when(F.col("hi") < 0, 1)), lambda s: s.isNotNull())
    asked = mine.select("block", F.col("value").alias("v"), F.explode(sides).alias("side")).distinct()
    far = beyond(level, asked, keep).groupBy("block", F.col("v").alias("value")).agg(F.max(F.when(F.col("side") == 0, F.col("at"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("at"))).alias("right"))
    pick = lambda a, b: F.when(F.col(a) >= 0, F.col(a)).otherwise(F.col(b))
    return keep(mine.join(far, ["block", "value"], "left").select(F.col("pos").alias("j"), F.col("value").alias("lcp"), pick("lo", "left").alias("lo"), pick("hi", "right").alias("hi")))


def explicit(seqs: DataFrame, count: int, keep: Keep) -> DataFrame:
    """Nodes that branch or end: first and last rank, depth, the parent's depth and figures that their chain shares."""
    pairs = runs(seqs, count, keep)
    inner = pairs.groupBy("lo", "hi", "lcp").agg(F.count("*").alias("merged")).select(F.col("lo").alias("lb"), (F.col("hi") - 1).alias("rb"), F.col("lcp").alias("depth"))
    ends = seqs.where(F.col("len") > F.greatest("lcp", "next")).select(F.col("rank").alias("lb"), F.col("rank").alias("rb"), F.col("len").alias("depth"))
    nodes = keep(inner.unionByName(ends))
    left = seqs.select(F.col("rank").alias("lb"), F.col("conv").alias("first"), F.col("len").alias("first_len"), F.col("lcp").alias("before"), F.col("upto_shared").alias("s0"), (F.col("upto_leaf") - F.col("leaf")).alias("l0"))
    right = seqs.select(F.col("rank").alias("rb"), F.col("next").alias("after"), F.col("upto_shared").alias("s1"), F.col("upto_leaf").alias("l1"))
    # nodes that share an end are nested, so n of them take some n * n / 2 turns: no rank gathers more than the root of all
    nodes = nodes.join(left, "lb").join(right, "rb").withColumn("above", F.greatest("before", "after"))
    wide = nodes.where("lb < rb").select(F.col("lb").alias("lo"), F.col("rb").alias("hi")).distinct()
    lows = range_least(seqs.select(F.col("rank").alias("pos"), F.col("conv").alias("value")), wide, keep).select(F.col("lo").alias("lb"), F.col("hi").alias("rb"), "least")
    nodes = nodes.join(lows, ["lb", "rb"], "left").withColumn("conv", F.coalesce("least", "first"))
    nodes = nodes.withColumn("j", F.when(F.col("before") == F.col("above"), F.col("lb")).otherwise(F.col("rb") + 1))
    nodes = keep(nodes.join(pairs.select("j", F.col("lo").alias("up")), "j", "left").drop("j", "first", "least", "before", "after"))
    children = nodes.where("above >= 0").groupBy(F.col("up").alias("lb"), F.col("above").alias("depth")).agg(F.count("*").alias("children"))
    # a node with very many children answers once per block of them
    key = [block_of("lb").alias("salt"), "up", "above"]
    names = nodes.where("above >= 0").select(*key).distinct().join(nodes.select(F.col("lb").alias("up"), F.col("depth").alias("above"), F.col("conv").alias("parent")), ["up", "above"])
    nodes = nodes.join(children, ["lb", "depth"], "left").withColumn("salt", block_of("lb")).join(names, ["salt", "up", "above"], "left")
    sums = seqs.select("class", "rank", "conv").repartition("class").sortWithinPartitions("class", "rank").select("class", "conv")
    sums = keep(sums.mapInArrow(trimmed(checksums), "class long, ends string"))
    return nodes.drop("salt", "up").join(sums.select(F.col("class").alias("lb"), "ends"), "lb", "left").withColumn("ends", F.when(F.col("first_len") == F.col("depth"), F.col("ends")))


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 5, spread: int = 9) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and text; null roles and texts become empty. Conversation c is
    rebuilt from the first h turns of conversation c - c % ``family`` (the remainder takes c's sign) and its own after
    the first h, where h is the CRC-32 of c in decimal, modulo ``spread``. Repeated rows are turns of their own, rows
    without an id are no conversation and are left out, an empty table gives no rows (not even a root), other columns
    are ignored. Turns are equal if the SHA-256 of role and text is.
    """
    made: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        made.append(stored(table))
        return made[-1]

    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null")
    token = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumns({"token": token, "size": F.octet_length("text").cast("long")})
    turns, convs = rebuilt(rows, keep, family, spread)
    blocks = keep(in_blocks(turns))
    mine, seqs = with_prefixes(blocks, ranked(blocks, convs, keep), keep)
    seqs = keep(seqs)
    count = seqs.count()
    after = seqs.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("next"))
    seqs = seqs.join(after, "rank", "left").withColumn("next", F.coalesce("next", F.lit(-1)).cast("long"))
    seqs = seqs.withColumn("leaf", (F.col("len") > F.col("next")).cast("long"))
    seqs = keep(numbered(seqs, "rank", [], keep, (), ("shared", "leaf")).drop("nth", "group", "start", "before_shared", "before_leaf"))
    nodes = explicit(seqs, count, keep).withColumn("d", F.explode(F.sequence(F.col("above") + 1, F.col("depth"))))
    nodes = nodes.withColumn("n", F.col("rb") - F.col("lb") + 1)
    own = mine.select(F.col("rank").alias("lb"), "block", F.posexplode("totals").alias("i", "total")).select("lb", (F.col("block") * BLOCK + F.col("i") + 2).alias("d"), "total")
    deep = (F.col("n") > 1) & (F.col("d") > 1)  # elsewhere nothing is saved above the node, or nothing stands above it
    nodes = nodes.where(deep).join(own, ["lb", "d"]).unionByName(nodes.where(~deep).withColumn("total", F.lit(0).cast("long")))
    last = F.col("d") == F.col("depth")
    out = nodes.select(
        F.col("conv").alias(id_col),
        F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") > F.col("above") + 1, F.col("conv")).otherwise(F.col("parent")).alias(f"parent_{id_col}"),
        F.col("n").cast("long").alias("n_convs"),
        F.when(last, F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        (F.col("l1") - F.col("l0")).cast("long").alias("n_leaves"),
        (F.col("s1") - F.col("s0") - (F.col("n") - 1) * F.col("total")).cast("long").alias("saved_tokens"),
        F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(hashlib.sha256(b"").hexdigest()).alias("ends_sha256"),
    )
    out = stored(out)
    for t in made:
        forget(t)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: DuckDB SQL for the rows of op13_prefix_trie, with every prefix spelt out.
ORACLE_SQL = """
with own as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), hashed as (
  select distinct c, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda s: ord(s)::bigint)),
    lambda crc, o: list_reduce(list_prepend(xor(crc, o), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 as h from own
), placed as (
  select h.c, o.pos as place, o.role, o.text from hashed h join own o on o.c = h.c - h.c % 5 and o.pos <= h.h
  union all select h.c, o.pos + 9, o.role, o.text from hashed h join own o on o.c = h.c and o.pos > h.h
), turns as (
  select c, row_number() over (partition by c order by place) as d, strlen(text) as size, sha256(length(role) || ':' || role || text) as token from placed
), paths as (
  select c, d, size, string_agg(token, '') over (partition by c order by d) as path from turns
  union all select c, 0, 0, '' from hashed
), sizes as (select c, max(d) as len from paths group by 1
), nodes as (
  select path, d, min(c) as conv_id, count(*) as n_convs, any_value(size) as size, coalesce(string_agg(case when len = d then c::varchar end, ',' order by c), '') as ends
  from paths join sizes using (c) group by path, d
), children as (select left(path, (d - 1) * 64) as path, d - 1 as d, count(*) as n from nodes where d > 0 group by 1, 2
), trees as (
  select left(b.path, u.up * 64) as path, u.up as d, sum(case when k.n is null then 1 else 0 end) as n_leaves, sum((b.n_convs - 1) * b.size) as saved
  from nodes b left join children k on k.path = b.path and k.d = b.d, lateral (select unnest(range(0, b.d + 1)) as up) u group by 1, 2
)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(k.n, 0)::bigint as n_children, t.n_leaves::bigint as n_leaves,
  t.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join trees t on t.path = n.path and t.d = n.d left join children k on k.path = n.path and k.d = n.d
left join nodes p on n.d > 0 and p.d = n.d - 1 and p.path = left(n.path, (n.d - 1) * 64)
"""
