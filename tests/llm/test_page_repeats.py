"""The suffix arrays over all blocks of a host's pages, against counting every run of tokens."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from docgauge.llm import html_text

SCHEMA = "page_id long, url string, html string"


def covered(words, known):
    out, mark = [], [False] * sum(map(len, words))
    flat = [w for ws in words for w in ws]
    for p in range(len(flat) - 7):
        if tuple(flat[p : p + 8]) in known:
            mark[p : p + 8] = [True] * 8
    at = 0
    for i, ws in enumerate(words):
        if sum(mark[at : at + len(ws)]) >= 0.8 * len(ws):
            out.append(i)
        at += len(ws)
    return out


def brute(rows):
    """(text, number of covered blocks) by page id; every row differs."""
    hosts = defaultdict(list)
    for page_id, url, page in rows:
        if html_text.blocks(page):
            hosts[url.split("/")[2]].append((page_id, html_text.blocks(page)))
    out = {i: ("", 0) for i, _, _ in rows}
    for pages in hosts.values():
        split = {i: [[t.split(" ") for r, t in parts if (r == html_text.OPEN) == o] for o in (True, False)] for i, parts in pages}
        every, some = Counter(), Counter()
        for both in split.values():
            runs = [{tuple(f[p : p + 8]) for p in range(len(f) - 7)} for f in ([w for ws in x for w in ws] for x in both)]
            every.update(runs[0] | runs[1])
            some.update(runs[0])
        least = lambda n: max(2, math.ceil(n * 0.1 - 1e-9))
        known = {r for r, n in every.items() if n >= least(len(pages))}
        known_open = {r for r, n in some.items() if n >= least(sum(bool(o) for o, _ in split.values()))}
        for i, parts in pages:
            gone, rest = covered(split[i][0], known_open), covered(split[i][1], known)
            places = [k for k, (r, _) in enumerate(parts) if r == html_text.OPEN]
            drop = {places[g] for g in gone}
            out[i] = (" ".join(t for k, (r, t) in enumerate(parts) if r != html_text.AWAY and k not in drop), len(gone) + len(rest))
    return out


def result(spark, rows):
    return {r.page_id: (r.text, r.n_repeated) for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.fixture(scope="module")
def mixed():
    """Pages with and without an article on three hosts, with passages shared by few and by many of them."""
    rng = np.random.default_rng(11)
    word = lambda n, k=400: " ".join(f"w{i}" for i in rng.integers(0, k, n))
    shared = [word(n) for n in (9, 14, 30, 8, 20, 12)]
    rows = []
    for i in range(160):
        pick = lambda: shared[rng.integers(0, 6)] if rng.random() < 0.3 else word(rng.integers(1, 40))
        menu = "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in (shared[1] if rng.random() < 0.5 else word(14)).split()) + "</ul>"
        body = f"<p>{pick()}</p>{menu}<div class=notice>{pick()}</div><p>{pick()}</p>"
        rows.append((i, f"http://h{min(i % 7, 2)}.org/{i}", f"<nav>{pick()}</nav>" + (f"<article>{body}</article>" if i % 3 else body) + f"<footer>{pick()}</footer>"))
    return rows


@pytest.mark.parametrize(("chars", "pages"), [(2_000_000, 20), (1, 15), (1, 1)])
def test_arrays_of_shards_find_what_counting_all_runs_finds(spark, monkeypatch, mixed, chars, pages):
    monkeypatch.setattr(html_text, "SHARD_CHARS", chars)
    monkeypatch.setattr(html_text, "SHARD_PAGES", pages)
    want = brute(mixed)
    assert result(spark, mixed) == want
    assert sum(n > 0 for _, n in want.values()) > 100 and any(n == 0 for _, n in want.values())


def test_array_judges_blocks_of_given_pages(spark):
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["page_id", "url", "html"]).to_pylist()]
    want = brute(rows)
    assert result(spark, rows) == want and sum(n for _, n in want.values()) > 100


def test_menu_of_links_inside_an_article_goes_where_it_repeats(spark):
    menu = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "home news sport culture money travel food contact".split()) + "</ul>"
    own = lambda i: "<ul>" + "".join(f"<li><a href=/{k}>source{i}.{k}</a></li>" for k in range(9)) + "</ul>"
    listed = "<ul><li>one of <a href=/x>eight</a> plain words in a list item</li></ul>"
    out = result(spark, [(i, f"http://h/{i}", f"<article><p>first {i}</p>{menu}{own(i)}{listed}</article>") for i in range(3)])
    assert {i: t for i, (t, _) in out.items()} == {i: f"first {i} " + " ".join(f"source{i}.{k}" for k in range(9)) + " one of eight plain words in a list item" for i in range(3)}


def test_page_is_packed_whole():
    parts = html_text.blocks("<nav>a b</nav><article><p>c d e</p><div class=notice>f g</div><ul><li><a>h</a></li></ul></article>")
    row, ats, opened, rest = html_text.unpacked(html_text.packed(-5, parts))
    want = lambda words: (html_text.token_ids(words).astype(np.int64) + 1).tolist()
    assert (row, ats.tolist(), opened[0].tolist(), rest[0].tolist()) == (-5, [1, 2], [2, 1], [2, 3])
    assert (opened[1].tolist(), rest[1].tolist()) == (want("f g h"), want("a b c d e"))
    assert len(set(html_text.token_ids(" ".join(f"w{i}" for i in range(1000))).tolist())) > 998
