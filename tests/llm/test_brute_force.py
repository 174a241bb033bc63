"""The operators against brute force, exact round trips, laws and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgauge.llm import decontamination, embedding_dedup, html_text, jaccard_join, packing, pii, quality, registry, secret_scan, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(t.doc_id, t.text, strict=True))


# ---- components


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- 1 decontamination


def fewest_edits(passage, text):
    """Sellers: the least edit distance of the passage to any substring."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(passage, 1):
        diagonal = row[:-1] + (text != c)
        up = row[1:] + 1
        new = np.concatenate([[i], np.minimum(diagonal, up)])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return row.min()


def test_decontamination_against_all_alignments(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghij "))
    prose = lambda n: "".join(rng.choice(letters, n))
    items = [(i, prose(n)) for i, n in enumerate((30, 60, 100, 150, 260))]

    def worn(s, k):
        s = list(s)
        for _ in range(k):
            at = int(rng.integers(len(s)))
            kind = rng.integers(3)
            s[at : at + (kind != 1)] = [] if kind == 0 else [str(rng.choice(letters))]
        return "".join(s)

    docs = [(100 + n, prose(80) + worn(items[n % 5][1], n // 5) + prose(80)) for n in range(60)] + [(300, prose(500)), (301, items[4][1][120:235])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, b).collect()}
    want = set()
    for item, text in items:
        passages = decontamination.Passages([(item, text)])
        for doc, t in docs:
            codes = decontamination.normalised(t)[0]
            if any(fewest_edits(p, codes) <= k for p, k in zip(passages.codes, passages.edits, strict=True)):
                want.add((doc, item))
    assert got == want and len(want) > 25


# ---- 2 main text


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_suffix_array_finds_what_pages_share(streams):
    run, first, pages = html_text.suffix_runs(streams, list(range(len(streams))), 3)
    where = defaultdict(set)
    for i, s in enumerate(streams):
        for p in range(len(s) - 2):
            where[tuple(s[p : p + 3])].add(i)
    at = 0
    for s in streams:
        for p in range(len(s) + 1):
            r = run[at + p]
            assert (r >= 0) == (p + 3 <= len(s)) and (r < 0 or pages[r] == len(where[tuple(s[p : p + 3])]))
        at += len(s) + 1
    assert len(first) == len(where) and (run[first] == np.arange(len(first))).all()


def test_open_blocks_that_repeats_cover_go(spark):
    menu = "<li>home</li><li>products</li><li>prices</li><li>support</li><li>contact</li><li>about us</li><li>today</li>"
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<ul>{menu}</ul><div>page {i} says a{i} b{i} c{i} d{i} e{i} &lt;f&gt;</div><ul>{menu}</ul>") for i in range(6)]
    rows.append((6, "http://h0.org/6", "<p>x</p>"))
    rows.append((7, "http://alone.org/", f"<p>{menu}</p>"))
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {**{i: f"page {i} says a{i} b{i} c{i} d{i} e{i} <f>" for i in range(6)}, 6: "x", 7: "home products prices support contact about us today"}


def test_prose_without_article_keeps_shared_phrases_and_quotes(spark):
    rng = np.random.default_rng(3)
    phrase = "at the end of the day it was clear to all of them that"
    quote = " ".join(f"quoted{i}" for i in range(60))
    advert = "buy one of our fine new products today and get another one for free"
    prose = {i: f"{' '.join(f'w{k}' for k in rng.integers(0, 10**6, 40))} {phrase} {' '.join(f'w{k}' for k in rng.integers(0, 10**6, 40))}" for i in range(200)}
    for i in (3, 4):
        prose[i] += " " + quote
    rows = [(i, f"http://large.org/{i}", f"<div>{advert}</div><p>{t}</p>" + (f"<blockquote>{quote}</blockquote>" if i in (5, 6) else "")) for i, t in prose.items()]
    out = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: t + (f" {quote}" if i in (5, 6) else "") for i, t in prose.items()}


def test_words_of_class_names_do_not_drop_prose(spark):
    shared = "like this page and share it with all of your many friends today"
    page = lambda i: f"""<article><div class="section-header"><p>first {i}</p></div><section class="social-history"><p>second {i}</p></section><section id="discussion"><h2>Discussion</h2><p>third {i}</p></section>
    <div class="share-box"><p>{shared}</p></div><div class="cookie-notice">accept</div><div id="comments"><p>reader</p></div><p>last {i}</p></article>"""  # noqa: E731
    out = html_text.main_text(spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(4)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: f"first {i} second {i} Discussion third {i} last {i}" for i in range(4)}


def test_article_is_kept_whole():
    page = """<!DOCTYPE html><html><head><title>t</title><script>var a = "</p>";</script><style>p{}</style></head><body>
    <header>top</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">accept</div><!-- c -->
    <article><h1>Title &amp; more</h1><p>one <b>two</b>three<img src="x">four<br>five</p><aside>side</aside><div class='ad'>buy</div>
    <form><input name="q">search</form><p>six&nbsp;&#233;</p><section id="comments"><p>reader says</p></section></article><footer>&copy; foot</footer></body></html>"""
    text = " ".join(t for role, t in html_text.blocks(page) if role == html_text.TEXT)
    assert text == "Title & more one twothreefour five six é"


# ---- 3 toxicity


def test_toxicity_ranks_held_out_rows(spark):
    out = registry.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = out[out.held_out]
    rank = held.score.rank().to_numpy()
    pos = (held.toxic == 1).to_numpy()
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / pos.sum() / (~pos).sum()
    assert auc > 0.95 and (held.predicted == held.toxic).mean() > 0.9


def test_gradient_of_the_risk():
    from docgauge.llm import toxicity

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 5)), (rng.random(60) < 0.4).astype(int)
    for w, b in ((rng.normal(size=5), 0.2), (-3 * np.abs(rng.normal(size=5)), -9.0)):  # the second has a negative bracket
        low = toxicity.risk(w, b, x, y, 0.5)[1] < 0
        value = lambda w, b, low=low: (toxicity.risk(w, b, x, y, 0.5, 1e-3)[0] if not low else 1e-3 / 2 * w @ w) + (-1 if low else 1) * toxicity.risk(w, b, x, y, 0.5)[1]
        got = toxicity.gradient(w, b, x, y, 0.5, 1e-3)
        for i in range(6):
            d = np.eye(6)[i] * 1e-5
            assert got[i] == pytest.approx((value(w + d[:5], b + d[5]) - value(w - d[:5], b - d[5])) / 2e-5, abs=1e-6)


# ---- 4 secrets and 8 personal data


def naive(patterns, text):
    return [(kind, m.start(), m.end()) for kind, pattern, flags, test in patterns for m in re.finditer(pattern, text, flags) if test(m)]


def card(m):
    digits = [int(c) for c in m[0] if c.isdigit()][::-1]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


SECRETS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII, lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
]
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0, card),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15),
]


def naive_secrets(text):
    return sorted(naive(SECRETS, text), key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


@given(st.lists(st.sampled_from(["password", "Secret", "api_key", "TOKEN", "ſecret", "apiKey", '"', "'", " ", ":", "=", "abcdef012345", "AKIA", "ABCDEFGHIJKLMN0", "0f" * 8, "/+", "é", "\n"]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_secret_rules_are_leftmost_matches(text):
    assert secret_scan.base_spans(text) == naive_secrets(text)


@given(st.lists(st.sampled_from(["a.b", "@", "x-y", ".", "com", "+", "1", "25", "255", "300", "4111 1111 1111 1111", "79927398713", "-", " ", "(", ")", "000", "é", "_", "%", "\n"]), max_size=16).map("".join))
@settings(max_examples=400, deadline=None)
def test_personal_rules_are_leftmost_matches(text):
    assert pii.base_spans(text) == naive(PERSONAL, text)


def test_base_columns_of_all_documents(spark, texts):
    digest = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    for name, rules in (("op4_secret_scan", naive_secrets), ("op8_pii", lambda t: naive(PERSONAL, t))):
        rows = registry.QUERIES[name](spark, SF).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = rules(texts[r.doc_id] or "")
            assert r.base_sha256 == digest(want)
            assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_method_finds_what_the_rules_miss(spark):
    key = "ghp_aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3z4"
    plain = [(i, f"nothing here but file_{i}.example.com/page and words") for i in range(40)]
    df = spark.createDataFrame([(100, f"use {key} to push")] + plain, "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.find_secrets(df).collect()}
    assert spans[100] == [("model", 4, 4 + len(key))]
    df = spark.createDataFrame([(100, "please call (555) 867-5309 or write to someone@mail.example.org today")] + plain, "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(df).collect()}
    assert ("email", 39, 63) in spans[100] and ("phone", 12, 26) in spans[100]


def test_addresses_of_long_zeros():
    zeros = "0" * 5000
    assert [s for s in pii.base_spans(f"{zeros}.1.1.1 and 1.1.1.{zeros}") if s[0] == "ip"] == [("ip", 0, 5006), ("ip", 5011, 10017)]


def test_entities_across_a_cut_are_found():
    text = " ".join(f"{i:03d}x" for i in range(390)) + " 555-867-5309 " + " ".join(f"{i:03d}x" for i in range(200))
    steps = list(pii.pieces(text))
    assert len(steps) > 1 and "".join(c[:n] for _, n, c in steps) == text[steps[0][0] : steps[-1][0] + steps[-1][1]]
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(steps, steps[1:], strict=False))


def segmentations(n, i=0):
    if i == n:
        yield []
        return
    for rest in segmentations(n, i + 1):
        yield [(i, i + 1, 4), *rest]
    for j in range(i + 1, n + 1):
        for y in range(4):
            for rest in segmentations(n, j):
                yield [(i, j, y), *rest]


def test_decoder_and_gradient_against_all_segmentations():
    from docgauge.llm import semicrf

    rng = np.random.default_rng(4)
    for n in (1, 2, 4):
        model = semicrf.SemiCrf(rng.normal(size=(4, semicrf.FEATURES)), rng.normal(size=(5, 5)))
        f = rng.normal(size=(n, semicrf.MAX_TOKENS, semicrf.FEATURES))

        def score(parts, model=model, f=f):
            total, before = 0.0, 4
            for i, j, y in parts:
                total += model.t[before, y] + (model.w[y] @ f[i, j - i - 1] if y < 4 else 0)
                before = y
            return total

        every = list(segmentations(n))
        best = max(every, key=score)
        assert model.decode(f) == [s for s in best if s[2] < 4]
        gold = [s for s in every[len(every) // 2] if s[2] < 4]
        gw, gt = model.gradient(f, gold)
        loss = lambda: score(every[len(every) // 2]) - np.logaddexp.reduce([score(p) for p in every])
        for array, grad, at in ((model.w, gw, (1, 3)), (model.w, gw, (3, 0)), (model.t, gt, (4, 2)), (model.t, gt, (2, 4))):
            was = array[at]
            array[at] = was + 1e-5
            up = loss()
            array[at] = was - 1e-5
            down = loss()
            array[at] = was
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_national_numbers_by_form(spark):
    forms = ["(555) 867-5309", "555-867-5309", "555.867.5309", "555 867 5309"]
    rows = [(i, f"please call {x} today") for i, x in enumerate(forms)] + [(10 + i, f"line {i} of 2024-05-0{i} with 1,234,567 and v1.2.34 words") for i in range(9)]
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == [("phone", 12, 12 + len(x))] for i, x in enumerate(forms)) and not any(out[10 + i] for i in range(9))


# ---- 5 Jaccard join


def shingle_set(text, w=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)} if len(ws) >= w else {tuple(ws)} if ws else set()


def check_components(spark, rows, words=3, num=90):
    sets = {i: shingle_set(t, words) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = least_reachable(ids, links)
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=words, num=num).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(sets[i]), want[i]) for i in ids}
    return links


def test_components_of_edited_copies(spark):
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(400)}"
    rows = []
    for g in range(25):
        base = [word() for _ in range(int(rng.integers(1, 300)))]
        for _ in range(6):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 40))):
                copy[int(rng.integers(len(copy)))] = word()
            rows.append((len(rows), " ".join(copy)))
            base = copy if rng.random() < 0.5 else base  # chains: far ends don't link directly
    links = check_components(spark, rows)
    assert len(links) > 60


def test_components_at_a_low_threshold_with_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)  # the open buckets are compared in pairs of blocks
    rng = np.random.default_rng(4)
    word = lambda k: f"w{rng.integers(k)}"
    passage, rows = [word(90) for _ in range(30)], []
    for g in range(30):
        base = [word(900) for _ in range(int(rng.integers(1, 160)))] + passage * (g % 3 > 0)
        for _ in range(8):
            copy = list(base)
            for _ in range(int(rng.integers(0, 1 + len(base) // 30))):
                copy[int(rng.integers(len(copy)))] = word(900)
            rows.append((len(rows), " ".join(copy)))
            base = copy if rng.random() < 0.3 else base
    assert len(check_components(spark, rows, 5, 80)) > 100


def test_oracle_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        want, got = duck.execute(sql).df(), registry.QUERIES[name](spark, SF).toPandas()
        key = want.columns[0]
        assert sorted(got.columns) == sorted(want.columns)
        pd.testing.assert_frame_equal(got[list(want.columns)].sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


@given(st.integers(1, 120), st.integers(0, 12), st.integers(0, 12), st.integers(0, 2**32), st.sampled_from([80, 90]), st.sampled_from([10, 10**4, 10**9]))
@settings(max_examples=600, deadline=None)
def test_linked_sets_share_a_signature(n, gone, new, seed, num, rows):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, n + new, dtype=np.uint64))
    a, b = pool[:n], np.concatenate([pool[min(gone, n) : n], pool[n:]])
    a, b = np.sort(a), np.sort(b)
    both = len(np.intersect1d(a, b))
    if len(b) and 100 * both >= num * (len(a) + len(b) - both) and both < max(len(a), len(b)):
        assert np.intersect1d(jaccard_join.signatures(a, rows, num), jaccard_join.signatures(b, rows, num)).size
        x, y = (np.frombuffer(jaccard_join.sketch(u), np.uint8)[None] for u in (a, b))
        assert jaccard_join._may_link(x, np.array([len(a)]), y, np.array([len(b)]), num, 100).all()


def test_sketches_tell_large_sets_apart_and_never_rule_out_a_link():
    rng = np.random.default_rng(11)
    bins = lambda u: np.frombuffer(jaccard_join.sketch(u), np.uint8)[None]
    may = lambda a, b: jaccard_join._may_link(bins(a), np.array([len(a)]), bins(b), np.array([len(b)]), 80, 100).all()
    for n in (500, 2040, 4090, 12_000, 30_000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        rng.shuffle(pool)
        assert not may(pool[:n], pool[n : 2 * n])
        assert may(pool[:n], pool[n // 10 : n + n // 100])  # also where one of the two has more bins
        assert may(pool[: n + n // 9], pool[:n])


def test_components_where_no_beginning_of_a_signature_is_rare(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MARK_BITS", 15)  # every bit is set, so all signatures are joined
    rows = [(i, " ".join(f"w{(i // 4) * 50 + k}" for k in range(50)) + f" x{i}" * (i % 4)) for i in range(60)]
    assert check_components(spark, rows)


# ---- 6 quality


def kneser_ney(words, order):
    """Interpolated modified Kneser-Ney by the book: counts, continuation counts and discounts in plain dictionaries."""
    top = Counter()
    for w, n in words.items():
        s = quality.BEGIN * (order - 1) + w + quality.END
        for i in range(len(w) + 1):
            top[s[i : i + order]] += n
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    stats = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        stats[k] = {i: max(min(i - (i + 1) * y * n[i + 1] / n[i], i - 0.05), 0.05) if n[i] else 0.5 for i in (1, 2, 3)}

    def p(gram):
        k = len(gram)
        c = counts[k]
        followers = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not followers:
            return p(gram[1:])
        cut = lambda v: min(stats[k][min(v, 3)], v)
        total, mass = sum(followers.values()), sum(map(cut, followers.values()))
        lower = 1 / (len(c) + 1) if k == 1 else p(gram[1:])
        return (followers[gram] - cut(followers[gram]) if gram in followers else 0) / total + mass / total * lower

    return p


def test_model_equals_the_definition(spark):
    words = {"banana": 5, "band": 3, "bad": 1, "dab": 2, "nab": 1, "abba": 4}
    df = spark.createDataFrame([("xx", w, n) for w, n in words.items()], "lang string, word string, n long")
    rows = quality.kneser_ney(df, 4).mapInArrow(quality.blobs, quality.BLOBS).collect()
    p = kneser_ney(words, 4)
    for shards in (1, 3):
        mine = [quality.Shard(rows, s, shards, 4) for s in range(shards)]
        for text in ("banana band", "xyz", "nabba dadb", ""):
            got = sum(m.scores(["xx"], [text])[0][0] for m in mine)
            want = 0.0
            for w in text.split():
                s = quality.BEGIN * 3 + w + quality.END
                want += sum(math.log(p(s[i : i + 4])) for i in range(len(w) + 1))
            assert got == pytest.approx(want, abs=1e-9)


def test_quality_keeps_the_good(spark):
    kept = {r.doc_id for r in registry.QUERIES["op6_quality_classifier"](spark, "/root/testdata/sf0.01").select("doc_id").collect()}
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    share = labels.doc_id.isin(kept).groupby(labels.quality).mean()
    assert share[1] > 0.99 and share[0] < 0.15


# ---- 7 packing


def test_pieces_rebuild_every_document(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = registry.QUERIES["op7_packing"](spark, SF).toPandas()
    by_doc = {i: g.sort_values("start") for i, g in out.groupby("doc_id")}
    assert set(by_doc) == set(texts)
    for i, g in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (g.doc_tokens == len(ids)).all() and g.length.sum() == len(ids)
        upto = 0
        for r in g.itertuples():
            assert r.start == upto and zlib.crc32(ids[upto : upto + r.length].tobytes()) == r.ids_crc32
            upto += r.length
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 2048
    assert out.length.sum() / 2048 / out.sequence_id.nunique() > 0.9


PIECES = []


@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from([" ", "\x1f", "\x85", "\u3000", "\u180e", "\ufeff", "Don't", "it's.", "ΟΔΟΣ", "e\u0301", "İ", "<|endoftext|>", "word!?", "１２"])), max_size=8).map("".join))
@settings(max_examples=400, deadline=None)
def test_word_pieces_equal_whole_texts(text):
    if not PIECES:
        import public_tokenizers

        PIECES.append(packing.WordPieces(public_tokenizers.path("word_bpe_49k.json")))
    pieces = PIECES[0]
    want = [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, "the end.")]
    ids, bounds = pieces.encode(pa.array([text, "", "the end."]))
    assert ids.tolist() == [*want[0], *want[1]] and bounds.tolist() == [len(want[0]), len(want[0]), len(want[0]) + len(want[1])]


def test_forgotten_words_are_learned_again():
    import public_tokenizers

    pieces = packing.WordPieces(public_tokenizers.path("word_bpe_49k.json"), known=40)
    for n in range(30):
        text = " ".join(f"word{n}x{i % 7}, The" for i in range(n))
        assert pieces.encode(pa.array([text]))[0].tolist() == pieces.tokenizer.encode(text, add_special_tokens=False).ids


def shard_of(docs, total=None, ends=None):
    """Index of documents of one-token words, with the frequencies of these documents."""
    ids, bounds = np.concatenate([np.array(d, np.uint16) for d in docs]), np.cumsum([len(d) for d in docs])
    ends = np.ones(1 << 16, bool)
    _, term, _, words = packing.distinct_terms(ids, bounds, ends)
    df = np.bincount(term, minlength=1 << packing.TERM_BITS).astype(np.float32)
    return packing.Bm25(ids, bounds, ends, df, len(docs), words.mean()), ids, bounds


def test_bm25_equals_a_plain_loop():
    rng = np.random.default_rng(6)
    docs = [rng.zipf(1.4, int(rng.integers(0, 60))) % 500 for _ in range(150)]
    index, _, _ = shard_of(docs)
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = Counter(t for d in docs for t in set(d.tolist()))
    for i in range(0, n, 7):
        want = []
        for d in docs:
            tf, score = Counter(d.tolist()), 0.0
            for t in set(docs[i].tolist()):
                if tf[t]:
                    score += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean))
            want.append(score)
        got = index.scores(i)
        alone = sum(math.log1p((n - 0.5) / 1.5) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for t, c in Counter(docs[i].tolist()).items() if df[t] == 1)
        want[i] -= alone  # terms that no other document holds are left out
        assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_seeds_take_their_best_unused_neighbours():
    index, _, _ = shard_of([[5, 6, 7], [90, 91], [5, 6, 8], [40, 41, 42], [6, 7, 90]])
    used = np.array([True, False, False, False, False])
    found, by_parts = (list(np.concatenate(list(index.neighbours(0, used, k)))) for k in (32, 1))
    assert found == by_parts
    assert set(found) == {2, 4} and list(index.scores(0)[found]) == sorted(index.scores(0)[found], reverse=True)
    assert packing.filled(np.array([4, 3, 4, 4, 4]), index, 12)[:3] == [0, *found]


def test_leading_term_is_the_most_frequent_that_fits():
    df = np.zeros(20, np.float32)
    df[[1, 2, 3, 4, 5]] = 1, 7, 8, 9, 50
    lead = lambda terms: packing.leading(np.zeros(len(terms), np.int64), np.array(terms, np.int64), df, 2, 8).tolist()
    assert lead([1, 2, 3, 4, 5]) == [3, -1] and lead([1, 4, 5]) == [4, -1] and lead([5]) == [5, -1] and lead([1]) == [1, -1]


def test_many_copies_are_dealt_and_kept_whole(spark):
    rows = [(i % 5, "the same few words again and again " * 3) for i in range(5000)] + [(i, f"own{i} words{i}") for i in range(300)] + [(None, None)] * 2500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.packed(df, window=512).toPandas()
    assert out.groupby("doc_id", dropna=False)["length"].sum().sum() == out[out.start == 0].doc_tokens.sum() and (out.start == 0).sum() == len(rows)
    part = (out.sequence_id.to_numpy().astype(np.int64) >> 32)
    assert len(np.unique(part)) > 4 and np.bincount(part).max() < len(out) / 2


# ---- 9 sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_every_cell_in_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims), -1).reshape(-1, dims)
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards_follow_the_law(spark, texts):
    out = registry.QUERIES["op9_hilbert_sharding"](spark, SF).toPandas()
    assert sorted(out.doc_id) == sorted(texts) and set(out.law) == {"rows"} and out.grown_shard.isna().all()
    counts = out.shard.value_counts()
    assert set(counts.index) == set(range(16)) and counts.max() - counts.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g))) and (g.sort_values("slot").hilbert.diff().dropna() >= 0).all()
    for r in out.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)


# ---- 10 embeddings


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (centre + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(50)]  # a hot vector
    out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cells_per_half=4)
    x = np.array([r[1] for r in rows], float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    want = least_reachable(range(len(rows)), list(zip(*np.nonzero(np.triu(link)), strict=True)))
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == {i: (link[i].sum(), want[i]) for i in range(len(rows))}
    assert link.sum() > 300
