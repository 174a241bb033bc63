"""Language codes: held-out accuracy, no leak of held-out labels, counts and decoding against plain loops, edge rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgauge.llm import language_id
from docgauge.llm.language_id import MIX, codewords, decode, languages, letters, ngram_counts

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    """The n-grams by Python strings, hashed one at a time."""
    clean = re.sub(r" +", " ", "".join(c if letters()[ord(c)] else " " for c in f" {text.lower()} "))
    out = Counter()
    for n in range(1, 5):
        for i in range(len(clean) - n + 1):
            v = sum(ord(c) * int(m) for c, m in zip(clean[i : i + n], MIX, strict=False)) % 2**32
            out[((v ^ v >> 15) * int(MIX[n % 4]) % 2**32) >> 20] += 1
    return out


@pytest.mark.parametrize("step", [1, 3, 7, 1 << 20])
def test_counts_against_a_plain_loop(monkeypatch, step):
    monkeypatch.setattr(language_id, "SLICE", step)
    for text in ["", " ", "a", "Une  école, 12 élèves!", "x" * 40, "日本語 и русский", "\U0001d54f\ud800 b"]:
        got = {i: n for i, n in enumerate(ngram_counts(text)) if n}
        assert got == plain_counts(text), text


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_are_apart(n):
    code = codewords(n)
    apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(apart) >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else 3)
    columns = {tuple(c * c[0]) for c in code.T}
    assert len(columns) == code.shape[1] and all(len(set(c)) == 2 for c in columns)  # no bit repeats or is constant


def test_decoding_mends_a_wrong_bit_and_marks_doubt():
    code = codewords(5)
    wrong = 6 * code
    for i in range(5):
        wrong[i, i] *= -1
    best, p, second = decode(wrong, code, np.ones(code.shape[1]))
    assert best.tolist() == [0, 1, 2, 3, 4] and (p > 0.9).all() and (second < 0.5 * p).all()
    best, p, second = decode(np.zeros((1, code.shape[1])), code, np.ones(code.shape[1]))
    assert best[0] == 0 and second[0] == p[0]  # nothing known: the first, ambiguous
    rng = np.random.default_rng(0)
    margins, weight = rng.normal(size=(50, code.shape[1])), rng.uniform(0.1, 2, code.shape[1])
    best, _, _ = decode(margins, code, weight)
    assert best.tolist() == [min(range(5), key=lambda c: sum(w * np.log1p(np.exp(-z * b)) for z, b, w in zip(row, code[c], weight, strict=True))) for row in margins]


def test_held_out_accuracy_without_their_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in languages(docs).collect()}
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in out.items() if r.held_out]
    assert len(out) == len(want) and 0.15 * len(want) < len(held) < 0.35 * len(want)
    assert np.mean([out[i].lang_pred == want[i] for i in held]) > 0.98
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    wrong = docs.withColumn("lang", F.when(part == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    again = {r.doc_id: r for r in languages(wrong).collect()}
    assert {i: (r.lang_pred, r.score) for i, r in again.items()} == {i: (r.lang_pred, r.score) for i, r in out.items()}


def test_edges(spark):
    words = {"en": "the cat sat on a mat and the dog ran off", "de": "der hund und die katze schlafen nicht über nacht", "fr": "le chat est sur la table à côté du chien"}
    rows = [(i, words[lang] + f" {i}", lang) for i in range(90) for lang in [list(words)[i % 3]]]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 -- 34 ²", "de"), (903, words["fr"], None), (None, words["de"], "en"), (904, (words["de"] + " ") * 20_000, None), (903, words["fr"], None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("id", "part", "held_out", "score", "at", "n", "pick")})
    got = {}
    for r in languages(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 and not got[i][0].ambiguous for i in (900, 901, 902))
    assert [r.lang_pred for r in got[903]] == ["fr", "fr"] and got[904][0].lang_pred == "de"
    assert got[None][0].lang_pred == "de" and not got[None][0].held_out
    assert all(0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert {r.lang_pred for r in languages(df.withColumn("lang", F.lit("zz"))).collect()} == {"und", "zz"}
