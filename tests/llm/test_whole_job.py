"""Cases that need the whole job: each failed while an operator did less."""

import numpy as np

import corpus_pipeline
from docgauge.llm import decontamination

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# ---- pipeline, near duplicates


def five_words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_stage_links_at_eight_tenths_of_five_words(spark):
    rng = np.random.default_rng(5)
    prose = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    texts, between = [], 0
    for _ in range(8):
        base = prose(200)
        edited = list(base)
        for at in rng.choice(200, 4, replace=False):
            edited[at] = "other"
        texts += [base, base + prose(30), edited, base[: int(rng.integers(120, 170))], base + prose(70)]
    sets = {i: five_words(" ".join(t)) for i, t in enumerate(texts)}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 100 * both >= 80 * either:
                between += 100 * both < 90 * either
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    docs = spark.createDataFrame([(i, " ".join(t), "en", "x", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(root.values())) and between > 8


def test_rows_of_one_id_fold_only_where_their_texts_do(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "en", "x", 1), (1, b, "en", "x", 2), (1, a + " more", "en", "x", 3), (2, None, "en", "x", 4), (2, None, "en", "y", 5), (3, b, "en", "x", 6), (None, a, "en", "x", 7)]
    out = [(r.doc_id, r.text and r.text[0]) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(out, key=str) == [(1, "a"), (1, "b"), (2, None), (None, "a")]


# ---- 1 decontamination


def edits_anywhere(passage, text):
    """The least edit distance of the passage to any substring (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_every_excerpt_and_the_full_budget_match(spark):
    rng = np.random.default_rng(8)
    prose = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    long, short = prose(233), {n: prose(n) for n in (16, 20, 23, 30, 31, 40, 60, 95)}
    docs, want = [], set()
    for k, n in enumerate((64, 75, 90, 99, 120, 148)):  # excerpts at offsets that no stride of the windows knows
        for at in (3, 17, 41, 62, 233 - n):
            docs.append((1000 * k + at, prose(40) + long[at : at + n] + prose(40)))
            want.add((1000 * k + at, 1))
    for n, text in short.items():  # substitutions, evenly spread: the worst place for q-grams
        for over in (0, 1):
            worn, k = list(text), n // 10 + over
            for i in range(k):
                worn[(i + 1) * n // (k + 1)] = "z"
            docs.append((10_000 + 10 * n + over, prose(40) + "".join(worn) + prose(40)))
            if edits_anywhere(text, docs[-1][1]) <= n // 10:
                want.add((docs[-1][0], n))
            elif any(edits_anywhere(text[s : s + 49], docs[-1][1]) <= 4 for s in {*range(0, n - 49, 16), n - 49} if n > 49):
                want.add((docs[-1][0], n))
    docs += [(90_000 + i, prose(300)) for i in range(20)]
    items = [(1, long), *short.items()]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and {(10_000 + 10 * n, n) for n in short} <= want
