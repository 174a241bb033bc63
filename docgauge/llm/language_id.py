"""Language identification by error-correcting output codes (Dietterich and Bakiri, 1995; Allwein et al., 2000).

Every language gets a codeword; one logistic classifier over hashed character n-grams predicts each bit of it. A text's
language is the codeword of least weighted logistic loss against the predicted margins, where a bit weighs as much as
it was right on training rows it had not seen. Texts whose two best codewords are nearly as close are marked ambiguous.
"""

from __future__ import annotations

import random
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import Batches, forget, stored, trimmed

#: Bounds of the training sample: texts a language, and texts in all.
PER_LANGUAGE, SAMPLE = 1000, 4000
#: Buckets of n-grams, and the longest n-gram.
BUCKETS, LONGEST = 4096, 4
FOLDS, HELD = 4, 2
#: Code points worked on at a time.
SLICE = 1 << 20
#: Texts whose second-best language has at least half the odds of the best are ambiguous.
DOUBT = 0.5
MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)])


def ngram_counts(text: str) -> np.ndarray:
    """Counts by bucket of the 1- to 4-grams of the text's letters; runs of anything else count as one space.

    Long texts are worked on in overlapping steps, so memory does not grow with the text beyond its code points.
    """
    out = np.zeros(BUCKETS, np.int64)
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    tail = np.zeros(0, np.uint32)
    for at in range(0, len(points), SLICE):
        part = points[at : at + SLICE]
        letter = letters()[part]
        part = np.where(letter, part, 32).astype(np.uint32)
        joined = np.concatenate([tail, part])
        keep = np.ones(len(joined), bool)
        keep[1:] = (joined[1:] != 32) | (joined[:-1] != 32)
        joined = joined[keep]
        fresh = len(tail)  # the tail's own n-grams are counted already
        value = np.zeros(len(joined), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(joined) < n:
                break
            value = value[: len(joined) - n + 1] + joined[n - 1 :] * MIX[n - 1]
            new = value[max(fresh - n + 1, 0) :]
            out += np.bincount((new ^ (new >> np.uint32(15))) * MIX[n % 4] >> np.uint32(20), minlength=BUCKETS)
        tail = joined[-(LONGEST - 1) :]
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts at unit length, so that long and short texts compare; float32 counts are overwritten."""
    x = np.sqrt(counts, out=counts if counts.dtype == np.float32 else None, dtype=np.float32)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
    return x


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of n classes as rows of -1 and 1.

    A bit is a split of the classes into two sides, no split twice: all of them up to five classes (exhaustive codes),
    beyond that 4 log2(n) + 12 random ones, the best of 200 draws by the least distance of two rows.
    """
    if n <= 1:
        return np.zeros((n, 0))
    rng, bits = random.Random(seed), int(4 * np.log2(n)) + 12
    best, least = None, -1
    for _ in range(1 if n <= 5 else 200):
        splits = set(range(1, 2 ** (n - 1))) if n <= 5 else set()
        while n > 5 and len(splits) < bits:
            splits |= {rng.getrandbits(n - 1)} - {0}
        m = np.array([[1.0 if s >> i & 1 else -1.0 for s in sorted(splits)] for i in range(n)])
        apart = (m.shape[1] - m @ m.T) / 2 + m.shape[1] * np.eye(n)
        if apart.min() > least:
            best, least = m, apart.min()
    return best


def fit_bits(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights (features + 1, bits) of one logistic classifier per column of ``target`` in -1 and 1, by Adam.

    Rows of weight 0 take no part; the matrix is never copied.
    """
    w = np.zeros((x.shape[1] + 1, target.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = (weight / weight.sum())[:, None].astype(np.float32)
    for t in range(1, rounds + 1):
        z = np.clip(target * (x @ w[:-1] + w[-1]), -30, 30)
        pull = (-target * share / (1 + np.exp(z))).astype(np.float32)
        g = np.concatenate([x.T @ pull, pull.sum(0, keepdims=True)]) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def decode(margins: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword per row by weighted logistic loss, its probability, and the runner-up's.

    Probabilities are of losses as exponents; equal losses go to the first class.
    """
    loss = (np.logaddexp(0, -np.clip(margins, -30, 30)[:, None] * code[None]) * weight).sum(-1)
    order = np.argsort(loss, 1, kind="stable")
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    rows = np.arange(len(p))
    return order[:, 0], p[rows, order[:, 0]], p[rows, order[:, 1]] if code.shape[0] > 1 else np.zeros(len(p))


def excerpt(text: str, pick: int) -> str:
    """3 to 30 words from somewhere in the text, so that the classifiers meet short texts too."""
    words = text.split()
    n = 3 + pick % 28
    at = pick // 28 % max(len(words) - n + 1, 1)
    return " ".join(words[at : at + n])


def train(counts: np.ndarray, labels: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classifier weights, code, bit weights) for labels 0..n-1; every fifth row judges the bits before the last fit."""
    code = codewords(n)
    x, target = scaled(counts), code[labels]
    weight = 1 / np.bincount(labels, minlength=n)[labels]
    judge = np.arange(len(x)) // 2 % 5 == 0  # a text and its excerpt stay on one side
    trust = np.ones(code.shape[1])
    if judge.any() and len(set(labels[~judge])) == n:
        w = fit_bits(x, target, np.where(judge, 0.0, weight))
        right = (np.sign(x @ w[:-1] + w[-1]) == target)[judge].mean(0)
        trust = np.log((right + 0.01) / (1.01 - right))
        trust = np.maximum(trust, 0.01) / np.maximum(trust, 0.01).mean()
    return fit_bits(x, target, weight), code, trust


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score in [0, 1], ambiguous.

    Learns from text and non-null lang of rows with crc32(id as text) mod 4 other than 2, from about ``per_language``
    distinct texts of each language, fewer if there are more than ``sample`` / ``per_language`` languages (bounds of the
    fit; languages and their sizes are counted over all rows). Whole texts are predicted, of all rows; id and lang take
    no part. lang_pred is "und", with score 0, where the text is null or has no letter, or nothing could be learned;
    otherwise score is the decoded probability, and ambiguous says that the runner-up has half of it or more. With one
    language all other texts are in it. A null id is neither held out nor learned from. Repeated rows stay rows, equal
    texts get equal answers, an empty table gives no rows, other columns are ignored.
    """
    part = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), part.alias("part"))
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    learn = base.where(F.col("part") != HELD).where(F.col("lang").isNotNull() & letter)
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}  # one row per language
    names = list(sizes)
    answer = base.select("id", F.coalesce(F.col("part") == HELD, F.lit(False)).alias("held_out"), F.when(letter, F.col("text")).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    model = None
    if len(names) > 1:
        each = min(per_language, max(1, sample // len(names)))
        draw = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30))
        quota = F.create_map(*[F.lit(v) for name, n in sizes.items() for v in (name, int((1 << 30) * min(1.0, each / n)))])
        drawn = learn.where(draw < quota[F.col("lang")]).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("pick")).dropDuplicates(["lang", "text"])

        def counted(batches: Batches) -> Batches:
            for batch in batches:
                for lang, text, pick in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "pick")), strict=True):
                    for t in (text, excerpt(text, pick)):
                        n = ngram_counts(t)
                        at = np.flatnonzero(n)
                        yield pa.RecordBatch.from_pydict({"lang": [lang], "pick": pa.array([pick], pa.int64()), "at": pa.array([at.astype(np.int32)]), "n": pa.array([n[at]])})

        rows = stored(drawn.mapInArrow(trimmed(counted), "lang string, pick long, at array<int>, n array<long>"))
        taken = rows.toArrow()  # bounded by the sample
        forget(rows)
        order = np.lexsort([taken["pick"].to_numpy(), np.array([names.index(v) for v in taken["lang"].to_pylist()])])
        counts = np.zeros((len(order), BUCKETS), np.float32)
        for i, j in enumerate(order):
            counts[i, taken["at"][int(j)].values.to_numpy()] = taken["n"][int(j)].values.to_numpy()
        labels = np.array([names.index(taken["lang"][int(j)].as_py()) for j in order])
        del taken
        if len(labels):
            model = train(counts, labels, len(names))

    def predict(batches: Batches) -> Batches:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            texts = batch.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            lang, score, doubt = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if some and model is not None:
                w, code, trust = model
                x = scaled(np.stack([ngram_counts(texts[i]) for i in some]))
                best, p, second = decode(x @ w[:-1] + w[-1], code, trust)
                lang[some], score[some], doubt[some] = np.array(names, object)[best], p, second >= DOUBT * p
            elif len(names) == 1:
                lang[some], score[some] = names[0], 1.0
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], names=["id", "held_out", "lang_pred", "score", "ambiguous"])

    return answer.mapInArrow(trimmed(predict), schema).withColumnRenamed("id", id_col)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
