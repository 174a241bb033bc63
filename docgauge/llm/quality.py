"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, thresholded per language.

The model is over the characters of words: order ``ORDER`` with begin and end marks, so its tables level off with the
language instead of with the corpus, and a word's probability depends on its type alone. All counts are DataFrame
aggregates over every trusted text. Scoring joins the texts with the count tables shard by shard: a shard holds every
entry whose history ends in its characters and at most about ``SHARD`` entries, and partial log-probabilities add up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import forget, stored, trimmed

ORDER = 5
BEGIN, END = "\x02", "\x03"
SHARD = 2_000_000
TRUSTED_BROADCAST = 2_000_000
HELD_OUT = 5
#: The quantile of held-out trusted text that is the threshold, estimated from the MEASURED one by an exponential tail, as
#: few languages have thousands of held-out texts; the measure allows texts shorter than LENGTH characters more.
QUANTILE, MEASURED, LENGTH = 0.9995, 0.99, 400
K = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words that a task holds: while it counts, and with their scores; both are passed by those of SLICE rows at most.
COUNTED, KNOWN = 300_000, 200_000
SLICE = 200


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) pre-aggregated within a partition; flushed when the dictionary grows."""
    from collections import Counter

    counts: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        lang = [g for g, c in counts.items() for _ in c]
        word = [w for c in counts.values() for w in c]
        n = [v for c in counts.values() for v in c.values()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    for batch in sliced(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update((text or "").split())
        if sum(map(len, counts.values())) > COUNTED:
            yield rows()
    yield rows()


def _cutting(order: int):
    """(lang, gram, n) of the highest order from (lang, word, n), pre-aggregated; linear in a word's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = {}

        def rows() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in counts], pa.string()) for i in (0, 1)]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], names=["lang", "gram", "n"])
            counts.clear()
            return out

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                padded = BEGIN * (order - 1) + word + END
                for i in range(len(word) + 1):
                    key = (lang, padded[i : i + order])
                    counts[key] = counts.get(key, 0) + n
                if len(counts) > COUNTED:
                    yield rows()
        yield rows()

    return run


def kneser_ney(words: DataFrame, order: int = ORDER, used: list[DataFrame] | None = None) -> DataFrame:
    """Rows (lang, size, gram, p, g) from (lang, word, n): log p of a seen gram, and log backoff g of it as a history.

    The stored tables that the rows are read from are added to ``used``.
    """
    grams = words.select("lang", "word", "n").mapInArrow(trimmed(_cutting(order)), "lang string, gram string, n long")
    top = stored(grams.groupBy("lang", "gram").agg(F.sum("n").alias("c")))
    tables = {order: top}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct left extensions
        tables[k] = stored(tables[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")))
    below = None
    out = None
    for k in range(1, order + 1):
        t = tables[k]
        times = t.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)])
        y = F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0)), F.lit(0.5))
        ratio = lambda i, y=y: F.coalesce(F.greatest(F.least(i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(i - 0.05)), F.lit(0.05)), F.lit(0.5))
        times = times.select("lang", *[ratio(i).alias(f"d{i}") for i in (1, 2, 3)])
        t = t.join(F.broadcast(times), "lang")  # one row a language
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.withColumn("cut", F.least(cut, F.col("c").cast("double"))).withColumn("hist", F.substring("gram", 1, k - 1))
        h = t.groupBy("lang", "hist").agg(F.sum("c").alias("total"), F.sum("cut").alias("mass"), F.count("*").alias("kinds"))
        t = t.join(h, ["lang", "hist"])
        gamma = F.col("mass") / F.col("total")
        if k == 1:
            t = t.withColumn("p", (F.col("c") - F.col("cut")) / F.col("total") + gamma / (F.col("kinds") + 1))
            floor = h.select("lang", F.lit(0).alias("size"), F.lit("").alias("gram"), F.log(gamma / (F.col("kinds") + 1)).alias("p"))
            backoff = None
        else:
            lower = below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
            t = t.withColumn("tail", F.substring("gram", 2, k - 1)).join(lower, ["lang", "tail"])
            t = t.withColumn("p", (F.col("c") - F.col("cut")) / F.col("total") + gamma * F.col("q"))
            backoff = h.select("lang", F.lit(k - 1).alias("size"), F.col("hist").alias("gram"), F.log(gamma).alias("g"))
        below = stored(t.select("lang", "gram", "p"))
        seen = below.select("lang", F.lit(k).alias("size"), "gram", F.log("p").alias("p"), F.lit(None).cast("double").alias("g"))
        parts = [seen] + ([floor.withColumn("g", F.lit(None).cast("double"))] if k == 1 else [backoff.withColumn("p", F.lit(None).cast("double")).select("lang", "size", "gram", "p", "g")])
        for part in parts:
            out = part if out is None else out.unionByName(part)
        if used is not None:
            used += [tables[k], below]
    return out


def gram_hash(codes: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = (h + c + np.uint64(1)) * K
        h ^= h >> np.uint64(29)
    return h


BLOBS = "lang string, size int, kind string, grams binary, logs binary"


def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Model rows as arrays of 16 bytes an entry: per language, size and kind ("p", "g") the hashes of grams and their logs."""
    for batch in batches:
        split: dict[tuple[str, int, str], tuple[list[str], list[float]]] = {}
        for lang, size, gram, p, g in zip(*(batch.column(c).to_pylist() for c in ("lang", "size", "gram", "p", "g")), strict=True):
            names, values = split.setdefault((lang, size, "g" if p is None else "p"), ([], []))
            names.append(gram)
            values.append(g if p is None else p)
        rows = []
        for (lang, size, kind), (names, values) in split.items():
            flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(names), size).astype(np.uint64)
            h = gram_hash([flat[:, i] for i in range(size)]) if size else np.zeros(len(names), np.uint64)
            rows.append((lang, size, kind, h.tobytes(), np.array(values, float).tobytes()))
        types = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["lang", "size", "kind", "grams", "logs"])


class Shard:
    """Sorted lookup tables of one shard of the model; scores the positions whose history ends in its characters."""

    def __init__(self, rows: list, shard: int, shards: int, order: int = ORDER):
        """``rows`` as of ``blobs``: lang, size, kind, grams, logs."""
        self.shard, self.shards, self.order = shard, shards, order
        self.tables: dict[tuple[str, int, str], tuple[np.ndarray, np.ndarray]] = {}
        self.floor: dict[str, float] = {}
        self.known: dict[str, dict[str, float]] = {}
        split: dict[tuple[str, int, str], tuple[list[bytes], list[bytes]]] = {}
        for lang, size, kind, grams, logs in rows:
            if size == 0:
                self.floor[lang] = float(np.frombuffer(logs)[0])
                continue
            parts = split.setdefault((lang, size, kind), ([], []))
            parts[0].append(grams)
            parts[1].append(logs)
        for key, (grams, logs) in split.items():
            h = np.frombuffer(b"".join(grams), np.uint64)
            at = np.argsort(h)
            self.tables[key] = (h[at], np.frombuffer(b"".join(logs))[at])

    def _find(self, key: tuple[str, int, str], codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if key not in self.tables:
            return np.zeros(len(codes[0]), bool), np.zeros(len(codes[0]))
        h, v = self.tables[key]
        want = gram_hash(codes)
        at = np.minimum(np.searchsorted(h, want), len(h) - 1)
        return h[at] == want, v[at]

    def learn(self, lang: str, words: list[str]) -> None:
        """Score word types and remember them."""
        n = self.order
        text = "".join(BEGIN * (n - 1) + w + END for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 1 for w in words])
        start = np.cumsum(size + n - 1) - (size + n - 1) + n - 1
        owner = np.repeat(np.arange(len(words)), size)
        at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        mine = codes[at - 1] % np.uint64(self.shards) == self.shard
        owner, at = owner[mine], at[mine]
        logp = np.full(len(at), self.floor.get(lang, 0.0))
        for k in range(1, n + 1):
            window = [codes[at - k + 1 + i] for i in range(k)]
            hit, p = self._find((lang, k, "p"), window)
            if k > 1:
                seen, g = self._find((lang, k - 1, "g"), window[:-1])
                logp = np.where(seen, logp + g, logp)
            logp = np.where(hit, p, logp)
        total = np.bincount(owner, logp, minlength=len(words))
        self.known[lang].update(zip(words, total.tolist(), strict=True))

    def scores(self, langs: list[str], texts: list[str | None]) -> tuple[list[float], list[int]]:
        split = [(t or "").split() for t in texts]
        if sum(map(len, self.known.values())) > KNOWN:
            self.known.clear()
        fresh: dict[str, set[str]] = {}
        for lang, ws in zip(langs, split, strict=True):
            fresh.setdefault(lang, set()).update(ws)
        for lang, ws in fresh.items():
            new = sorted(ws.difference(self.known.setdefault(lang, {})))
            for i in range(0, len(new), 20_000):
                self.learn(lang, new[i : i + 20_000])
        sums = [float(sum(map(self.known[lang].__getitem__, ws))) for lang, ws in zip(langs, split, strict=True)]
        return sums, [sum(map(len, ws)) + len(ws) for ws in split]


def _scoring(shard: Shard):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sums, n = shard.scores(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.float64()), pa.array(n, pa.int64())], names=["id", "lang", "logp", "n"])

    return run


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, shard_rows: int = SHARD) -> DataFrame:
    """Rows (id, lang, perplexity, threshold, kept), one per distinct id and language; ``trusted`` has one id column.

    One in ``HELD_OUT`` trusted texts (by hash) stays out of the counts, so that the quantiles are of unseen text. A
    text's measure is its cross-entropy per character above the language's median, times the root of its share of
    ``LENGTH`` characters where it is shorter; it is rejected above the language's ``quantile`` of that measure, which is
    the ``MEASURED`` one carried on along an exponential tail. Null, empty and blank
    texts have no perplexity and are kept, as are texts of a language without trusted text; a null language is a
    language of its own. Rows that repeat an id and language, or have none, are scored together. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    sure = trusted.select(F.col(trusted.columns[0]).cast("long").alias("id")).where("id is not null").distinct()
    if sure.count() <= TRUSTED_BROADCAST:
        sure = F.broadcast(sure)
    held = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0
    words = base.join(sure, "id").where(~held).select("lang", "text").mapInArrow(trimmed(word_counts), "lang string, word string, n long")
    used: list[DataFrame] = []
    model = stored(kneser_ney(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), used=used))
    for t in used:
        forget(t)
    shards = max(1, -(-model.count() // shard_rows))
    # the character that a position's history ends in; for a backoff weight that is the gram's own last character.
    # Spark's ascii gives the code point of any character
    last = F.when(F.col("p").isNotNull(), F.substring("gram", -2, 1)).otherwise(F.substring("gram", -1, 1))
    scored = None
    for s in range(shards):
        mine = model if shards == 1 else model.withColumn("last", last).where(F.col("size").isin(0, 1) & F.col("p").isNotNull() | (F.pmod(F.ascii("last"), F.lit(shards)) == s))
        rows = mine.select("lang", "size", "gram", "p", "g").mapInArrow(blobs, BLOBS).collect()  # 16 bytes an entry
        part = base.mapInArrow(trimmed(_scoring(Shard(rows, s, shards))), "id long, lang string, logp double, n long")
        scored = part if scored is None else scored.unionByName(part)
    scored = scored.groupBy("id", "lang").agg(F.sum("logp").alias("logp"), (F.sum("n") / shards).cast("long").alias("n"))
    entropy = stored(scored.withColumn("bits", F.when(F.col("n") > 0, -F.col("logp") / F.col("n"))))
    of_trusted = entropy.join(sure, "id").where(held & (F.col("n") > 0))
    at = of_trusted.groupBy("lang").agg(F.percentile_approx("bits", 0.5, 10000).alias("median"))
    excess = (F.col("bits") - F.col("median")) * F.sqrt(F.least(F.col("n"), F.lit(LENGTH)) / LENGTH)
    tail = math.log(1 - quantile) / math.log(1 - MEASURED)
    limit = of_trusted.join(F.broadcast(at), "lang").groupBy("lang", "median").agg((F.percentile_approx(excess, MEASURED, 10000) * tail).alias("limit"))
    known = model.where("size = 0").select("lang")
    out = entropy.join(F.broadcast(limit.join(known, "lang")), "lang", "left")  # one row a language
    bound = F.col("median") + F.col("limit") / F.sqrt(F.least(F.nullif("n", F.lit(0)), F.lit(LENGTH)) / LENGTH)
    out = out.select(F.col("id").alias(id_col), "lang", F.exp("bits").alias("perplexity"), F.exp(bound).alias("threshold"), F.coalesce(F.col("bits") <= bound, F.lit(True)).alias("kept"))
    return out


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps; trusted text is what ``labels`` marks as of quality 1."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return perplexities(docs, labels.where("quality = 1").select("doc_id")).where("kept").drop("kept")
