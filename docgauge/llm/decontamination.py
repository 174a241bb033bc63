"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A passage of n characters and a region within k edits of it share at least n + 1 - q - q*k q-grams (Ukkonen, 1992),
all on diagonals at most k apart. Shared q-grams are counted in overlapping diagonal bands; bands that meet the bound
are verified by an alignment restricted to the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import trimmed

Q = 8
RATE = 0.1
WINDOW, STRIDE = 100, 50
#: Short windows of items: every excerpt of SHORT + SHORT_STRIDE - 1 = 64 normalised characters holds a whole one.
SHORT, SHORT_STRIDE = 49, 16
#: Shared q-grams that the choice of a passage's q leaves as its bound, so that one common q-gram is no candidate.
SHARED = 4
#: Characters of benchmark text that one pass holds in memory; larger benchmarks take several passes over the documents.
BLOCK_CHARS = 2_500_000
#: Characters and rows that a task looks at together; each shared q-gram takes some 100 bytes meanwhile.
STEP_CHARS, STEP_ROWS = 200_000, 500
GAP = 4 * WINDOW
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BITS = 22


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Per code point below 2**16: its lower-case letter or digit, or 32 for anything else."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, positions in ``text``): letters and digits in lower case, each run of anything else one space."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(raw < (1 << 16), _folding()[raw & 0xFFFF], raw)
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    at = np.flatnonzero(keep)
    return codes[at], at


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of each q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = wide[:n].copy()
    for i in range(1, q):
        h *= BASE
        h += wide[i : i + n]
    return h * MIX


class Passages:
    """Windows of benchmark items with their q-grams sorted for lookup, in a table for each q.

    An item is a passage whole or, beyond ``WINDOW`` characters, in long windows, and in short ones beyond ``SHORT``.
    Short passages take a smaller q where the lemma would leave less than ``SHARED`` q-grams at their full number of edits.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.item, self.codes, self.offset, self.edits = [], [], [], []
        for item_id, text in items:
            codes, _ = normalised(text or "")
            lo = 1 if len(codes) and codes[0] == 32 else 0
            codes = codes[lo : len(codes) - (1 if len(codes) > lo and codes[-1] == 32 else 0)]
            if len(codes) < 2 * Q:
                continue
            for size, stride in ((WINDOW, STRIDE), (SHORT, SHORT_STRIDE)):
                if size < WINDOW and len(codes) <= size:
                    continue  # whole already
                starts = [0] if len(codes) <= size else sorted({*range(0, len(codes) - size, stride), len(codes) - size})
                for s in starts:
                    part = codes[s : s + size]
                    self.item.append(item_id)
                    self.codes.append(part)
                    self.offset.append(s)
                    self.edits.append(int(rate * len(part) + 1e-9))
        self.edits = np.array(self.edits, np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.q = np.clip((self.length + 1 - SHARED) // (self.edits + 1), 1, Q)
        self.needed = self.length + 1 - self.q - self.q * self.edits
        self.tables = {int(q): self._table(int(q)) for q in np.unique(self.q)}

    def _table(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted hashes, windows, places, which leading bits occur) of the q-grams of the passages that take this q."""
        mine = np.flatnonzero(self.q == q)
        hashes = [grams(self.codes[i], q) for i in mine]
        h = np.concatenate(hashes)
        w = np.repeat(mine, [len(x) for x in hashes])
        j = np.concatenate([np.arange(len(x)) for x in hashes])
        order = np.argsort(h, kind="stable")
        seen = np.zeros(1 << BITS, bool)
        seen[h >> np.uint64(64 - BITS)] = True
        return h[order], w[order], j[order], seen

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal of the band) of the bands whose distinct shared q-grams meet the lemma's bound."""
        found = [self._candidates(codes, q) for q in self.tables]
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))

    def _candidates(self, codes: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        hashes, windows, places, seen = self.tables[q]
        h = grams(codes, q)
        at = np.flatnonzero(seen[h >> np.uint64(64 - BITS)])
        lo = np.searchsorted(hashes, h[at], "left")
        n = np.searchsorted(hashes, h[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        w, j = windows[pick], places[pick]
        step = self.edits[w] + 1
        diag = np.repeat(at, n) - j + 2 * WINDOW
        band = diag // step
        span = np.int64(len(codes) + 4 * WINDOW)
        key = np.concatenate([w * span + band, w * span + band - 1])
        # a q-gram of the passage counts once in a band, however often the text repeats it there
        pairs = np.sort(key * (WINDOW + 1) + np.concatenate([j, j]))
        grouped = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] // (WINDOW + 1)
        first = np.flatnonzero(np.concatenate([[True], grouped[1:] != grouped[:-1]]))
        keys, count = grouped[first], np.diff(np.concatenate([first, [len(grouped)]]))
        w = keys // span
        ok = count >= self.needed[w]
        return w[ok], (keys[ok] % span) * (self.edits[w[ok]] + 1) - 2 * WINDOW

    def aligned(self, codes: np.ndarray, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edit distance, end in ``codes``) of the best match of each window inside its band of diagonals."""
        widest = int(self.edits.max(initial=0))
        wide = 2 * (widest + 1) + 2 * widest + 1
        lane = np.arange(wide)
        base = first - self.edits[w]
        cost = np.zeros((len(w), wide), np.int64)
        padded = np.zeros((len(w), WINDOW), np.uint32)
        for r, i in enumerate(w):
            padded[r, : self.length[i]] = self.codes[i]
        limit = 2 * (self.edits[w] + 1) + 2 * self.edits[w] + 1
        cost[lane[None] >= limit[:, None]] = 10**6
        for row in range(int(self.length[w].max(initial=0))):
            col = base[:, None] + lane + row
            char = np.where((col >= 0) & (col < len(codes)), codes[np.clip(col, 0, len(codes) - 1)], 0)
            down = np.concatenate([cost[:, 1:], np.full((len(w), 1), 10**6)], 1) + 1
            new = np.minimum(cost + (char != padded[:, row][:, None]), down)
            new = np.minimum.accumulate(new - lane, axis=1) + lane
            new[lane[None] >= limit[:, None]] = 10**6
            live = row < self.length[w]
            cost = np.where(live[:, None], new, cost)
        best = cost.argmin(1)
        return cost[np.arange(len(w)), best], base + best + self.length[w]

    def regions(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, start, end, edits) of verified regions, the best of each window and place."""
        w, first = self.candidates(codes)
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for i in range(0, len(w), 4096):
            cost, end = self.aligned(codes, w[i : i + 4096], first[i : i + 4096])
            for a, c, e in zip(w[i : i + 4096], cost, end, strict=True):
                if c <= self.edits[a]:
                    spot = (int(a), int(e) // WINDOW)
                    if spot not in out or out[spot][3] > c:
                        out[spot] = (int(a), max(0, int(e - self.length[a])), int(e), int(c))
        return list(out.values())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """Rows (id, item_id, start, end, edits): an item's best region in a document, in code points of the whole text.

    A passage is a benchmark item, or each of its windows of ``WINDOW`` normalised characters if it is longer, and each
    of its windows of ``SHORT``, so that every excerpt of 64 normalised characters holds one. A passage matches where a
    region lies within ``rate`` edits per character; an item's best region is of its longest passage, then of the fewest
    edits. Case, punctuation and white space do not count.
    Items of fewer than 2*Q letters and digits are too short to be evidence and match nothing; null or empty texts
    match nothing; repeated documents give repeated rows; empty tables give no rows. Documents are never shuffled.
    The benchmark is held per pass in blocks of at most ``BLOCK_CHARS`` characters, whatever its size.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} long, item_id long, start long, end long, edits long"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).distinct().collect()
        passages = Passages([(r["i"], r["t"]) for r in sorted(rows, key=lambda r: (r["i"] is None, r["i"], r["t"]))], rate)
        if passages.codes:
            out = out.unionByName(base.mapInArrow(trimmed(_finder(passages, id_col)), schema))
    return out


def _finder(passages: Passages, id_col: str):
    def search(texts: list[tuple[int, str]]) -> Iterator[tuple[int, int, int, int, int]]:
        parts, places, starts, at = [], [], [], 0
        for _, text in texts:
            codes, where = normalised(text)
            parts += [codes, np.zeros(GAP, np.uint32)]
            places.append(where)
            starts.append(at)
            at += len(codes) + GAP
        codes, starts = np.concatenate(parts), np.array(starts)
        best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        rank: dict[tuple[int, int], tuple[int, int, int]] = {}
        for w, a, b, cost in passages.regions(codes):
            doc = int(np.searchsorted(starts, a + (b - a) // 2, "right")) - 1
            where, item = places[doc], passages.item[w]
            lo, hi = (int(np.clip(x - starts[doc], 0, len(where) - 1)) for x in (a, b - 1))
            row = (texts[doc][0], item, int(where[lo]), int(where[hi]) + 1, cost)
            mine = (-int(passages.length[w]), row[4], row[2])
            if (doc, item) not in best or mine < rank[doc, item]:
                best[doc, item], rank[doc, item] = row, mine
        yield from best.values()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, STEP_ROWS) for b in batches for i in range(0, b.num_rows, STEP_ROWS)):
            held, size, rows = [], 0, []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.append((doc_id, text))
                    size += len(text)
                if size >= STEP_CHARS:
                    rows += search(held)
                    held, size = [], 0
            rows += search(held) if held else []
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[id_col, "item_id", "start", "end", "edits"])

    return run


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage: the items, and the best region of each."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, bench)
