"""Exact n-gram Jaccard join by universe-partition pigeonhole (after PartEnum, and Deng et al., PVLDB 2015).

Sets of similar size differ in at most H elements when their Jaccard similarity reaches the threshold. Hashing splits
the universe of tokens into m segments; x of them are indexed whole and d with their one-deletion neighbourhoods, with
x + 2d = H + 1. If every whole segment held an error and every other segment two, there would be H + 1 errors, so two
linked sets share a signature. A cost model picks d for each size band. Shared signatures are only candidates; every
link is verified on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import BROADCAST_ROWS, connected_components, forget, stored, trimmed

NUM, DEN = 90, 100
WORDS = 3
BLOCK = 1024
#: Bins of a sketch: the least, doubled until a bin holds no more than LOAD elements on average, and the most.
BINS, LOAD, MOST_BINS = 256, 8, 4096
#: Signatures are first counted by so many leading bits; what is shared is marked in a bitmap of two to the power of
#: MARK_BITS bits, 16 MB however large the corpus.
KEY_BITS, MARK_BITS = 40, 27
A, B, C, D = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; A-Z lower-cased, words split at ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mixed(out + A) + h[i : len(h) - n + 1 + i]
    out = np.sort(mixed(out + np.uint64(n)))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


@lru_cache(maxsize=64)
def bands(num: int, den: int, longest: int) -> np.ndarray:
    """First size of each band; a set's partners of at least its size lie in its own band or the next."""
    edges = [1]
    while edges[-1] <= longest:
        edges.append(edges[-1] * den // num + 1)
    return np.array([*edges, edges[-1] * den // num + 1])


def _poisson(mean: float, most: int) -> float:
    """Chance of at most ``most`` at this mean; beyond 700, where its first term vanishes, the normal approximation."""
    if mean > 700:
        return 0.5 * (1 + math.erf((most + 0.5 - mean) / math.sqrt(2 * mean)))
    term = total = math.exp(-mean)
    for i in range(1, most + 1):
        term *= mean / i
        total += term
    return min(total, 1.0)


#: What the cost model expects of texts: one row in ROWS_SHARING shares a run of SHARED tokens with a given one; PAIR is
#: the work of comparing two sketches against that of shuffling one signature.
SHARED, ROWS_SHARING, PAIR = 30, 200, 0.02


@lru_cache(maxsize=4096)
def plan(low: int, high: int, rows: int, num: int, den: int) -> tuple[int, int, int, int]:
    """(segments, those with one-deletion neighbourhoods, spare errors, poor content) of the band of sizes low..high.

    The cost of a choice is a set's signatures plus the partners that it expects among ``rows`` sets without a link: those
    that are as poor as itself, and those that share no more than a passage, of which one element alone in its segment is
    a signature unless such content counts as poor.
    """
    errors = (den - num) * 2 * high // (den + num)
    best = (math.inf, 0, 0, 0, 0)
    for d in sorted({0, *range(min(4, (errors + 1) // 2) + 1), (errors + 1) // 4, (errors + 1) // 2}):
        for poor in (0, 1):
            spare = 0
            while spare <= 2 * errors + 2:
                m = errors + 1 + spare - d
                whole, each = m - d, low / m
                few, fewer = _poisson(each, poor + 1), _poisson(each, poor)
                tail = 1 - _poisson(whole * fewer + 2 * d * few, spare)
                chance = tail**2 * min(1.0, whole * fewer**2 + d * few**2)
                if poor == 0:
                    alone = few - fewer
                    chance += min(1.0, (whole + 2 * d) * alone**2 * SHARED / low) / ROWS_SHARING
                best = min(best, (whole + d * (1 + each) + PAIR * rows * chance, m, d, spare, poor))
                spare += max(1, spare // 4)
    return best[1:]


def signatures(u: np.ndarray, rows: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Signatures of a set in its own band and, as the smaller partner, in the next.

    A segment's content of at most ``poor`` elements is poor: it says little, and many sets share it. A set leaves the
    signatures of poor content out where the segments that could match by them hold at most ``spare`` errors: as
    whole + 2d = H + 1 + spare, linked sets then agree in another segment. The rest of the sets emits them, so two linked
    sets that agree in poor content alone both do.
    """
    n = len(u)
    edges = bands(num, den, 1 << (int(n).bit_length() + 1))
    k = int(np.searchsorted(edges, n, "right")) - 1
    out = []
    for band in (k, k + 1):
        low, high = int(edges[band]), int(edges[band + 1]) - 1
        if (den - num) * 2 * high < den + num or (band > k and n * den < num * low):
            continue  # no room for one error (only equal sets link), or too small for any partner there
        m, d, spare, poor = plan(low, high, rows, num, den)
        seed = np.uint64((band + 1) << 32)
        seg = (mixed(u + seed) % np.uint64(m)).astype(np.int64)
        value = mixed(u ^ D)
        order = np.argsort(seg, kind="stable")
        count = np.bincount(seg, minlength=m)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[order])])
        total = np.diff(upto[np.concatenate([[0], np.cumsum(count)])])
        tag = np.arange(m, dtype=np.uint64) + seed
        every = (count[d:] <= poor).sum() + 2 * (count[:d] <= poor + 1).sum() > spare
        out.append(mixed(total + mixed(tag + A))[(count > poor) | every])
        if d:
            some = (seg < d) & ((count[seg] > poor + 1) | every)
            out.append(mixed(total[seg[some]] - value[some] + mixed(tag[seg[some]] + A)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(u: np.ndarray) -> bytes:
    """Elements by hash bin, 255 at most: sketches differ by no more, summed over the bins, than their sets do.

    Large sets have more bins, as two unlike sets of many elements a bin look alike. Bins are ranges of the hash, so
    neighbours add up to a sketch of fewer bins, with the same bound.
    """
    bins = BINS
    while bins * LOAD < len(u) and bins < MOST_BINS:
        bins *= 2
    return np.minimum(np.bincount((mixed(u ^ C) >> np.uint64(65 - bins.bit_length())).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _widths(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.binary_length(column).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)


def _bins(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of at least ``width`` bins as rows of ``width`` bins."""
    size = np.fromiter(map(len, sketches), np.int64, len(sketches))
    out = np.empty((len(sketches), width), np.int16)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at] = np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), width, -1).sum(axis=2, dtype=np.int16)
    return out


def _may_link(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, num: int, den: int) -> np.ndarray:
    """False only for rows whose sketches and sizes rule the threshold out; bins of the finer sketches are added up."""
    width = min(x.shape[1], y.shape[1])
    x, y = (z if z.shape[1] == width else z.reshape(len(z), width, -1).sum(axis=2, dtype=np.int16) for z in (x, y))
    apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
    return (apart * (den + num) <= (den - num) * (nx + ny)) & (np.minimum(nx, ny) * den >= np.maximum(nx, ny) * num)


def _screened(num: int, den: int):
    """The pairs (id, hub) that their sketches leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
            width, keep = np.minimum(_widths(b.column(3)), _widths(b.column(5))), np.zeros(b.num_rows, bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                x, y = (_bins(b.column(i).take(pa.array(at)).to_pylist(), int(w)) for i in (3, 5))
                keep[at] = _may_link(x, n[at], y, m[at], num, den)
            yield b.select(["id", "hub"]).filter(pa.array(keep))

    return run


def _loose(num: int, den: int):
    """Of rows (sig, i, j, id, label, n, sk) sorted by sig, i, j and n: edges that join those of a group that may link, if of two labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in _with_end(batches):
            if b is not None:
                rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if rest is None or not rest.num_rows:
                continue
            key = np.stack([rest.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            ends = np.append(starts[1:], len(key))
            if b is not None:  # the last group may go on
                starts, ends = starts[:-1], ends[:-1]
            stop = int(ends[-1]) if len(ends) else 0
            part, rest = rest.slice(0, stop), rest.slice(stop)
            if not stop:
                continue
            ids, label, n, sks = part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(6).to_pylist()
            root = list(range(stop))

            def top(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for a, z in zip(starts, ends, strict=True):
                upto = a + np.searchsorted(n[a:z] * num, n[a:z] * den, "right")
                sk = _bins(sks[a:z], min(map(len, sks[a:z])))
                for i in range(a, z - 1):
                    j = i + 1 + np.flatnonzero(label[i + 1 : upto[i - a]] != label[i])
                    if len(j):
                        for other in j[_may_link(sk[j - a], n[j], sk[i - a][None], n[i], num, den)]:
                            x, y = top(i), top(int(other))
                            root[max(x, y)] = min(x, y)
            tops = np.array([top(i) for i in range(stop)])
            some = tops != np.arange(stop)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[tops[some]])], names=["a", "b"])

    return run


def _marked(bits: np.ndarray):
    """Of rows (id, sigs): a row (id, sig) for each signature whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            sig = b.column(1).flatten().to_numpy(zero_copy_only=False)
            at = sig.view(np.uint64) >> np.uint64(64 - MARK_BITS)
            keep = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            owner = np.repeat(b.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(owner[keep]), pa.array(sig[keep])], names=["id", "sig"])

    return run


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The bits of all signatures that begin with one of ``keys``, as bytes of a fixed number."""
    bits = np.zeros(1 << (MARK_BITS - 3), np.uint8)
    at = keys.select(F.shiftright("key", KEY_BITS - MARK_BITS).alias("at"))
    size = 8 * 4096  # of the bitmap that the aggregate makes
    for r in at.groupBy((F.col("at") / size).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("at") % size).alias("bits")).toLocalIterator():
        bits[r["block"] * 4096 :][:4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _signing(rows: int, words: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            sizes, first, second, sigs, sks = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                u = shingles(text, words)
                sizes.append(len(u))
                first.append(mixed(u ^ A).sum(dtype=np.uint64))
                second.append(mixed(u ^ C).sum(dtype=np.uint64))
                sigs.append(signatures(u, rows, num, den) if len(u) else u)
                sks.append(sketch(u))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            flat = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), longs(first), longs(second), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sks, pa.binary())], names=["id", "n", "h1", "h2", "sigs", "sk"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            sets = [shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["id", "s"])

    return run


def _forest(num: int, den: int):
    """For one group: the sets of two blocks of a candidate part; returns a spanning forest of links between labels."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("id").reset_index(drop=True)
        ids, label = g["id"].to_numpy(), g["label"].to_numpy()
        sets = [np.asarray(s, np.int64) for s in g["s"]]
        n = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        code = np.cumsum(new) - 1
        shared = np.bincount(code)[code] > 1
        code, owner = code[shared], owner[shared]
        both = np.zeros((len(sets), len(sets)), np.float32)
        cuts = np.searchsorted(code, np.arange(0, (code[-1] + 1 if len(code) else 0), 4096)) if len(code) else []
        for i, a in enumerate(cuts):
            b = cuts[i + 1] if i + 1 < len(cuts) else len(code)
            x = np.zeros((len(sets), 4096), np.float32)
            x[owner[a:b], code[a:b] % 4096] = 1
            both += x @ x.T
        both = np.rint(both).astype(np.int64)
        link = (den * both >= num * (n[:, None] + n[None] - both)) & (label[:, None] != label[None])
        root = np.arange(len(sets))
        rows = []
        for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                rows.append((ids[i], ids[j]))
        return pd.DataFrame(rows, columns=["a", "b"]).astype("int64")

    return run


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table for a join: broadcast up to ``most`` rows, beyond that both sides are shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: id, n_shingles, component_id under links den * |A and B| >= num * |A or B|.

    A set is the distinct word n-grams of a whole text, with fewer words the whole sequence; a null, empty or blank text
    has an empty set, links with nothing and is its own component. Equal sets are folded first. In each signature's
    bucket every member meets the bucket's least member only (a star, linear in its size); buckets whose members these
    links do not join are then compared in pairs of blocks of ``BLOCK`` members, buckets of the same members once. A
    sketch of ``BINS`` to ``MOST_BINS`` bytes rules most pairs out before sets move; every link is verified on the sets. No bucket is
    capped, no group meets in one task and no group's pairs are written out. Rows that repeat an id share its component;
    a null id keeps a null component; empty tables give no rows; other columns are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.count()
    signed = stored(docs.mapInArrow(trimmed(_signing(rows, words, num, den)), "id long, n long, h1 long, h2 long, sigs array<long>, sk binary"))
    folded = stored(signed.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")))
    reps = signed.join(_small(folded.select(F.col("rep").alias("id")).distinct()), "id", "left_semi")
    # most signatures are one set's alone: a count of their beginnings finds the others, so that few rows move with their ids
    keys = reps.select(F.explode("sigs").alias("sig")).select(F.shiftrightunsigned("sig", 64 - KEY_BITS).alias("key"))
    shared = stored(keys.groupBy("key").count().where("count > 1").select("key"))
    held = stored(reps.select("id", "sigs").mapInArrow(trimmed(_marked(_bitmap(shared))), "id long, sig long"))
    # hubs are aggregated before the shuffle, and the join back is one that a hot signature can be split in
    hubs = stored(held.groupBy("sig").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1"))
    cand = stored(held.join(hubs, "sig").select("id", "sig", "hub", "size"))
    # signatures are the largest table, and nothing reads them again
    marks = stored(reps.select("id", "n", "sk").dropDuplicates(["id"]))
    with_signatures, signed = signed, stored(signed.select("id", "n", "h1", "h2"))
    forget(with_signatures)
    stars = cand.where("id <> hub").select("id", "hub").distinct()
    hub_marks = marks.select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col("sk").alias("hub_sk"))
    stars = stars.join(marks, "id").join(hub_marks, "hub").select("id", "hub", "n", "sk", "m", "hub_sk")
    stars = stored(stars.mapInArrow(trimmed(_screened(num, den)), "id long, hub long"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """The sets of the given distinct ids."""
        return stored(docs.join(_small(ids), "id", "left_semi").mapInArrow(trimmed(_sets(words)), "id long, s array<long>").dropDuplicates(["id"]))

    sets = sets_of(stars.select("id").union(stars.select("hub")).distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets pass the threshold."""
        left, right = sets.select(F.col("id").alias("a"), "s"), sets.select(F.col("id").alias("b"), F.col("s").alias("t"))
        tested = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("s", "t")).alias("i"), (F.size("s") + F.size("t")).alias("both"))
        return stored(tested.where(F.col("i") * den >= (F.col("both") - F.col("i")) * num).select("a", "b"))

    # first each set against the least of its hubs, then against the hubs that this leaves in other components
    near = stars.groupBy("id").agg(F.min("hub").alias("hub"))
    early = linked(near.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    part_of = connected_components(early)
    other = part_of.select(F.col("id").alias("hub"), F.col("component_id").alias("hub_c"))
    apart = stars.join(near.withColumnRenamed("hub", "done"), "id").where("hub <> done").join(part_of, "id", "left").join(other, "hub", "left")
    apart = apart.where(F.coalesce("component_id", "id") != F.coalesce("hub_c", "hub"))
    late = linked(apart.select(F.col("id").alias("a"), F.col("hub").alias("b")))
    links = stored(early.unionByName(late))
    first = connected_components(links)
    # buckets of three or more that the star's links leave in several components need their other pairs
    named = stored(cand.where("size > 2").join(first, "id", "left").select("id", "sig", F.coalesce("component_id", "id").alias("label")))
    members = [F.count("*").alias("size"), F.min("id").alias("least"), F.max("id").alias("most"), F.bit_xor(F.xxhash64("id")).alias("all")]
    open_ = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), *members).where("low <> high")
    open_ = stored(open_.groupBy("size", "least", "most", "all").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    placed = named.join(_small(open_), "sig").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # every block meets every block of its bucket once: as the lower of the two, or the higher
    spread = placed.select("sig", "id", "label", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    spread = spread.select("sig", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "id", "label").join(marks, "id")
    dealt = spread.select("sig", "i", "j", "id", "label", "n", "sk").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "n")
    loose = stored(dealt.mapInArrow(trimmed(_loose(num, den)), "a long, b long").distinct())
    # what the sketches leave, some near misses and the last links, is compared on its sets, again in pairs of blocks
    parts = stored(connected_components(loose).withColumnRenamed("component_id", "part"))
    sizes = parts.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = parts.join(sizes, "part").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = placed.select("part", "id", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    spread = spread.select("part", "id", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"))
    late_sets = sets_of(parts.select("id"))
    carried = spread.join(late_sets, "id").join(first, "id", "left").select("part", "i", "j", "id", "s", F.coalesce("component_id", "id").alias("label"))
    more = stored(carried.groupBy("part", "i", "j").applyInPandas(_forest(num, den), "a long, b long"))
    final = connected_components(links.unionByName(more))
    of_rep = folded.join(final, folded.rep == final.id, "left").select("h1", "h2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    # rows of one id are one node, so the id's own label comes before its set's
    out = stored(signed.select("id", "n", "h1", "h2").join(of_rep, ["h1", "h2", "n"], "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id")))
    for t in (signed, folded, marks, shared, held, hubs, cand, stars, sets, early, late, links, named, open_, loose, parts, late_sets, more):
        forget(t)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at Jaccard similarity 0.9 of three-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB SQL for the rows of op5_jaccard_join.
ORACLE_SQL = r"""
with recursive base as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from base
), shingles as (select doc_id, unnest(s) as s from sets
), pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as shared from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2
), links as (
  select a, b from pairs join sets p on p.doc_id = a join sets q on q.doc_id = b where 100 * shared >= 90 * (len(p.s) + len(q.s) - shared)
), edges as (select a, b from links union all select b, a from links
), reach(id, root) as (select doc_id, doc_id from sets union select e.b, r.root from reach r join edges e on e.a = r.id
), least_root as (select id, min(root) as component_id from reach group by 1)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.component_id from sets s join least_root r on r.id = s.doc_id
"""
