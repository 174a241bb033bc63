"""Main text of web pages: a suffix array per host over all blocks of all pages, then a check by the page's structure.

A page is read into blocks. The token streams of a host's pages are concatenated, menus, adverts, footers and articles
alike, and long token substrings that repeat on a share of its pages are found in the suffix array: a block that they
cover is a candidate. The check by structure comes after it. A candidate that is the article's own (or, without one, the
main element's) stays, whatever repeats; blocks of menus, headers, footers, asides, forms, notices, adverts or comment
sections go, also those of one page only, which no array can find. On every other block the array decides: on blocks of
pages without an article, on blocks of an article that only a class or id of doubtful meaning marks, and on list items
of an article that consist of a link. A host's pages are dealt to shards with an array each, however many it has: what
repeats on a share of all its pages does so on that share of one shard's, so candidates are found shard by shard and
then counted in all of them.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import forget, stored, trimmed

#: Tokens of a substring that may count as boilerplate, the share of a host's pages (two at least) that must hold it, and
#: the share of a block's tokens that such substrings must cover for the block to go; any other block stays whole.
REPEAT, PAGES, COVER = 8, 0.1, 0.8
#: Characters of markup per shard of a host, unless that leaves a shard fewer than ``SHARD_PAGES`` pages.
SHARD_CHARS, SHARD_PAGES = 2_000_000, 20
NAME, BARE, ATTRIBUTE, GAP, EQUALS = (re.compile(p) for p in (r"[a-zA-Z][^\s/>]*", r"[^\s>]+", r"[^\s/>=]+", r"[\s/]*", r"\s*=\s*"))
#: Text and the tag without attributes that follows it.
PLAIN = re.compile(r"([^<]*+)<(/?)([a-zA-Z][^\s/>]*+)>")
#: Elements whose content is no text, up to their end tag; of the last group an end tag may be missing.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "textarea", "iframe", "noscript", "template", "svg", "select")}
ENDLESS = frozenset(("noscript", "template", "svg", "select"))
# fixed values: element names by role, and words of class, id and role attributes that name page furniture
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("br hr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button head title fieldset".split())
MARKS = frozenset(
    "ad ads adv adbox adslot adunit adsense advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr popup modal newsletter related recommended toolbar pagination pager".split()
)
COMMENTS = frozenset("comment comments commentlist commenting disqus guestbook".split())
TALK = frozenset("respond discussion discussions reply replies".split())
DOUBTFUL = frozenset("menu header notice notices alert subscribe signup share social skip".split())
#: Words that say nothing about the content of an element whose class or id they are part of.
FILLERS = frozenset("box block area container wrapper wrap widget slot bar item items list unit top bottom left right inner outer site page main col column row panel module content text title link links button buttons icons thread form".split())
#: More of them, beside names of adverts and comments.
OWNERS = frozenset("post posts story stories reader readers user users visitor visitors customer your our new latest recent blog entry section".split())
#: Names and properties of what readers' comments consist of, and headings that open them; two such parts make a comment section.
CONTROLS = frozenset("reply avatar author username commenter permalink vote votes upvote timestamp".split())
HEADING = re.compile(r"(?:\d+ )?(?:(?:reader|user|all|recent) )?(?:comments?|replies|responses|discussion)(?: \(?\d+\)?)?:?|leave a (?:reply|comment)|join the (?:discussion|conversation)", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KINDS = ("comment", "usercomments", "wpadblock", "wpheader", "wpfooter", "wpsidebar", "sitenavigationelement")
ASIDE_ARTICLES = frozenset("comment comments reply replies related teaser ad advert sponsored promo".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
TEXT, AWAY, OPEN = 0, 1, 2
#: What an element's name and attributes say of its content: the page's own, furniture, perhaps furniture, perhaps comments.
OWN, GONE, DOUBT, TALKS = 0, 1, 2, 3


def attributes(page: str, at: int, end: int, last: dict[str, int]) -> tuple[list[tuple[str, str]], int]:
    """(name, value) pairs of a tag from behind its name, and the place behind its ">", or -1 where it has none before ``end``.

    A quote begins a value only behind "=", and only if it has a partner; ``last`` holds the last place of each quote.
    """
    found = []
    while True:
        at = GAP.match(page, at, end).end()
        if at >= end:
            return found, -1
        if page[at] == ">":
            return found, at + 1
        m = ATTRIBUTE.match(page, at, end)
        at, name, value = (m.end(), m[0].lower(), "") if m else (at + 1, "", "")
        e = EQUALS.match(page, at, end)
        if e:
            at = e.end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and last[quote] > at and (close := page.find(quote, at + 1, end)) > 0:
                value, at = page[at + 1 : close], close + 1
            elif m := BARE.match(page, at, end):
                value, at = m[0], m.end()
        if name:
            found.append((name, value))


def scanned(page: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """("text", text, []), ("open", tag, attributes) and ("close", tag, []) of a page, in one pass that never goes back.

    Comments, declarations and the content of scripts and the like are left out; an unclosed comment or script takes the
    rest of the page. A "<" that begins no tag is text, as is all that follows the last ">". Where quotes keep a tag from
    ending at all, this and all later tags end at the next ">" whatever the quotes.
    """
    at, end, quoted = 0, len(page), True
    last = {c: page.rfind(c) for c in "'\">"}
    endless: set[str] = set()
    while at < end:
        m = PLAIN.match(page, at)
        if m and (tag := m[3].lower()) not in RAW:
            at = m.end()
            if m[1]:
                yield "text", m[1], []
            yield "close" if m[2] else "open", tag, []
            continue
        i = page.find("<", at)
        if i < 0 or last[">"] < i:
            comment = page.find("<!--", at)
            yield "text", page[at : comment if comment >= 0 else end], []
            return
        sign = page[i + 1 : i + 2]
        closing = sign == "/"
        m = NAME.match(page, i + 1 + closing)
        if i > at:
            yield "text", page[at:i], []
        if sign == "!" and (page.startswith("<!--", i) or page.startswith("<![CDATA[", i)):
            mark = "-->" if page[i + 2] == "-" else "]]>"
            stop = page.find(mark, i + 2)
            if stop < 0:
                return
            at = stop + 3
        elif sign in ("!", "?") or (closing and not m):
            at = page.find(">", i) + 1
        elif not m:
            yield "text", "<", []
            at = i + 1
        else:
            tag = m[0].lower()
            behind = m.end()
            pairs, stop = attributes(page, behind, end, last) if quoted else ([], -1)
            if stop < 0:
                quoted, stop = False, page.find(">", behind) + 1
                pairs, _ = attributes(page, behind, stop, last)
            at = stop
            if tag not in RAW:
                yield ("close", tag, []) if closing else ("open", tag, pairs)
            elif not closing and tag not in endless and not (tag == "svg" and page[at - 2] == "/"):
                stop = RAW[tag].search(page, at)
                if stop:
                    at = page.find(">", stop.end()) + 1 or end
                elif tag in ENDLESS:
                    endless.add(tag)
                else:
                    return


def class_words(value: str) -> Iterator[list[str]]:
    """The words of each name of a class or id attribute: "adBox" and "ad-slot-728x90" are ad, box and ad, slot."""
    for token in value.split():
        yield [w.lower() for w in re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])", token)]


def furniture(tag: str, pairs: list[tuple[str, str]]) -> int:
    """What an element's name and attributes say of its content.

    A class or id counts only if all its words name furniture or say nothing: "cookie-notice" does, "section-header" not.
    """
    if tag in FURNITURE:
        return GONE
    if not pairs or tag in ("body", "html", "main"):
        return OWN
    found = OWN
    for name, value in pairs:
        low = value.lower()
        if (name == "hidden" and tag not in INLINE) or (name == "role" and low in ROLES) or (name == "aria-hidden" and low == "true") or name.startswith("data-ad-"):
            return GONE
        if (name == "itemprop" and low == "comment") or (name == "itemtype" and low.rstrip("/").rpartition("/")[2] in KINDS) or (name == "aria-label" and low in ("advertisement", "comments")):
            return GONE
        if name in ("class", "id"):
            for words in class_words(value):
                if tag == "article":
                    found = GONE if any(w in ASIDE_ARTICLES for w in words) else found
                    continue
                said = [w for w in words if w not in FILLERS]
                marked = [w for w in said if w not in OWNERS]
                if not marked:
                    continue
                if all(w in MARKS or w in DOUBTFUL or w in COMMENTS or w in TALK for w in marked):
                    if any(w in MARKS for w in marked) or (tag not in INLINE and any(w in COMMENTS for w in marked)):
                        return GONE
                    if tag not in INLINE and any(w in TALK for w in marked):
                        found = TALKS
                    elif said == marked and found == OWN and any(w in DOUBTFUL for w in marked):
                        found = DOUBT
    return found


def control(tag: str, pairs: list[tuple[str, str]]) -> bool:
    """The element is a part that readers' comments are made of: an author, a time, a reply link, votes."""
    if tag == "time":
        return True
    return any((n in ("class", "id") and any(w in CONTROLS for ws in class_words(v) for w in ws)) or (n == "itemprop" and v.lower() in ("author", "datepublished")) or (n == "rel" and v.lower() == "author") for n, v in pairs)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of the page's blocks in order. White space inside a block is one space; empty blocks are left out.

    An element that a name or its first heading calls a discussion is the readers' if it holds two parts of comments. An
    article's list items whose whole text is one or more links are open, as menus look like that.
    """
    out: list[tuple[int, str]] = []
    held: list[str] = []
    link = plain = False  # inside a link of this block, and whether the block has text outside of its links
    stack: list[list] = []  # tag, what it says, whether it is an article or main, its first block, controls before it
    away = inside = doubt = controls = 0
    had_article = had_main = False
    depth: dict[str, int] = defaultdict(int)  # open elements by tag, so that a stray end tag costs no search

    def flush() -> None:
        nonlocal link, plain
        menu, link, plain = not plain and bool(stack) and stack[-1][0] == "li", False, False
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((AWAY if away else 10 + inside + (100 if doubt or menu else 0) if inside else OPEN, text))
                if stack and stack[-1][0] in HEADINGS and len(stack) > 1 and stack[-2][1] == OWN and not stack[-2][2] and stack[-2][3] == len(out) - 1 and HEADING.fullmatch(text):
                    stack[-2][1] = TALKS

    def leave(entries: list[list]) -> None:
        nonlocal away, inside, doubt
        for tag, said, own, first, before in reversed(entries):
            depth[tag] -= 1
            away -= said == GONE
            doubt -= said == DOUBT
            inside -= 2 if tag == "article" else own
            if said == TALKS and controls - before >= 2:
                out[first:] = [(AWAY, t) for _, t in out[first:]]

    for kind, tag, pairs in scanned(page or ""):
        if kind == "text":
            held.append(html.unescape(tag) if "&" in tag else tag)
            plain |= not link and not tag.isspace()
            continue
        opens = kind == "open"
        if opens and (pairs or tag == "time"):
            controls += control(tag, pairs)
        if tag in INLINE and not (pairs and furniture(tag, pairs)):
            if opens or not depth[tag]:
                link = opens if tag == "a" else link
                continue
        if tag in VOID:
            if tag in BREAKS:
                flush()
            continue
        flush()
        if opens:
            if stack and stack[-1][0] == "p":  # a paragraph ends where any block begins
                leave([stack.pop()])
            said, own = furniture(tag, pairs) if pairs else GONE if tag in FURNITURE else OWN, tag in ("article", "main")
            if own:
                had_article |= tag == "article"
                had_main |= tag == "main"
            stack.append([tag, said, own, len(out), controls])
            depth[tag] += 1
            away += said == GONE
            doubt += said == DOUBT
            inside += 2 if tag == "article" else own
            continue
        if depth[tag]:
            at = len(stack) - 1
            while stack[at][0] != tag:
                at -= 1
            gone = stack[at:]
            del stack[at:]
            leave(gone)
    flush()
    leave(stack)
    want = 12 if had_article and any(r % 100 >= 12 for r, _ in out) else 11 if had_main and any(r % 100 >= 11 for r, _ in out) else None
    if want is None:
        return [(r if r in (AWAY, OPEN) else OPEN, t) for r, t in out]
    return [((OPEN if r >= 100 else TEXT) if r % 100 >= want else AWAY, t) for r, t in out]


def _runs(s: np.ndarray, left: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(run of each suffix or -1, a suffix of each run) of concatenated streams, each ended by a 0; ``left`` is the
    number of tokens from each place to its stream's end.

    A suffix array by prefix doubling, sorted by ``repeat`` tokens at least; a run is the suffixes, neighbours in it, that
    share their first ``repeat`` tokens. Suffixes of fewer tokens belong to none.
    """
    rank, width = s.astype(np.int64), 1
    while True:
        ahead = np.zeros(len(s), np.int64)
        ahead[: len(s) - width] = np.where(left[: len(s) - width] >= width, rank[width:] + 1, 0)
        key = rank * (rank.max() + 2) + ahead
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        width *= 2
        if width >= repeat or new[-1] == len(s) - 1:
            break
    order = order[left[order] >= repeat]
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(repeat):
        same &= s[order[1:] + k] == s[order[:-1] + k]
    run = np.full(len(s), -1)
    of_order = np.concatenate([[0], np.cumsum(~same)])[: len(order)]
    run[order] = of_order
    return run, order[np.flatnonzero(np.diff(of_order, prepend=-1))]


def _pages(run: np.ndarray, page: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct pages of each of ``n`` runs, from the run and the page of each place."""
    places = np.bincount(run, minlength=n)
    again = places[run] > 1
    size = int(page.max(initial=0)) + 1
    pairs = np.sort(run[again] * size + page[again])
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    return np.where(places > 1, np.bincount(pairs // size, minlength=n), places)


def suffix_runs(texts: list[list[str]], pages: list[int], repeat: int = REPEAT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run of each suffix of all streams or -1, a suffix of each run, number of distinct pages of each run)."""
    vocabulary: dict[str, int] = {}
    s = np.array([i for toks in texts for i in [*(vocabulary.setdefault(t, len(vocabulary) + 1) for t in toks), 0]], np.int64)
    left = np.concatenate([np.arange(len(toks), -1, -1) for toks in texts])
    run, first = _runs(s, left, repeat)
    page = np.repeat(np.unique(pages, return_inverse=True)[1], [len(toks) + 1 for toks in texts])
    return run, first, _pages(run[run >= 0], page[run >= 0], len(first))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
        parts = [[t for r, t in blocks(page) if r != AWAY] for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(parts, pa.list_(pa.string()))], names=["id", "url", "row", "parts"])


def token_ids(text: str) -> np.ndarray:
    """24 bits of the hash of each token of a text whose tokens one space parts."""
    crc = np.fromiter(map(zlib.crc32, text.encode("utf-8", "surrogatepass").split(b" ")), np.uint64)
    return (crc * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.uint32)


def packed(row: int, parts: list[tuple[int, str]]) -> bytes | None:
    """A page's blocks as one value: its row, the places of its open blocks among those that are not away, the length of
    each block and the tokens' hashes, first of the open blocks and then of all others. None for a page without blocks."""
    if not parts:
        return None
    ats, opened, rest, at = [], [], [], 0
    for role, text in parts:
        if role == OPEN:
            ats.append(at)
        (opened if role == OPEN else rest).append(text)
        at += role != AWAY
    both = opened + rest
    head = np.array([len(opened), len(rest), *ats, *(t.count(" ") + 1 for t in both)], np.int32)
    ids = token_ids(" ".join(both))
    return np.int64(row).tobytes() + head.tobytes() + ids.astype(np.uint16).tobytes() + (ids >> 16).astype(np.uint8).tobytes()


def unpacked(page: bytes) -> tuple[int, np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, places of the open blocks, (lengths, tokens) of the open blocks, (lengths, tokens) of the others). A token is its
    hash plus 1, as 0 ends a stream."""
    n, m = np.frombuffer(page, np.int32, 2, 8)
    head = np.frombuffer(page, np.int32, 2 * n + m, 16)
    at = 16 + 4 * len(head)
    size = (len(page) - at) // 3
    ids = np.frombuffer(page, np.uint16, size, at).astype(np.int64) + (np.frombuffer(page, np.uint8, size, at + 2 * size).astype(np.int64) << 16) + 1
    opened = head[n : 2 * n].sum()
    return int(np.frombuffer(page, np.int64, 1)[0]), head[:n], (head[n : 2 * n], ids[:opened]), (head[2 * n :], ids[opened:])


def _names(s: np.ndarray, repeat: int) -> np.ndarray:
    """64-bit name of the ``repeat`` tokens at each place that has so many before the end of ``s``."""
    h = s.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    n = max(len(s) - repeat + 1, 0)
    name = np.zeros(n, np.uint64)
    for k in range(repeat):
        name = (name ^ (name >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return name.view(np.int64)


def _streams(pages: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's streams, two of each page: (tokens, tokens left in the stream, page, whether the stream is of open blocks)."""
    parts = [ids for page in pages for _, ids in unpacked(page)[2:]]
    sizes = [len(ids) + 1 for ids in parts]
    end = np.zeros(1, np.int64)
    number = np.repeat(np.arange(len(parts)), sizes)
    return np.concatenate([x for ids in parts for x in (ids, end)]), np.concatenate([np.arange(n - 1, -1, -1) for n in sizes]), number // 2, number % 2 == 0


def _share(n: int, share: float) -> int:
    return int(np.ceil(n * share - 1e-9))


LOCAL = "host string, name long, pages long, open_pages long"


def _table(rows: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in types.items()], names=list(types))


def _local(repeat: int, share: float):
    """For each shard of a host: names of the runs of its suffix array that a share of its pages holds, and, without a
    name, the number of its pages and of those with open blocks. The only shard of a host asks for two pages at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, shards, pages in ((h.as_py(), n.as_py(), p.as_py()) for b in batches for h, n, p in zip(*b.columns, strict=True)):
            s, left, page, opened = _streams(pages)
            of, first = _runs(s, left, repeat)
            n, n_open, least = len(pages), len(np.unique(page[opened & (left > 0)])), 2 if shards == 1 else 1
            inside = of >= 0
            every, some = _pages(of[inside], page[inside], len(first)), _pages(of[inside & opened], page[inside & opened], len(first))
            good = (every >= max(least, _share(n, share))) | ((some > 0) & (some >= max(least, _share(n_open, share))))
            names = _names(s, repeat)[first[good]].tolist() if good.any() else []
            yield _table({"host": [host] * (len(names) + 1), "name": [None, *names], "pages": [n, *[0] * len(names)], "open_pages": [n_open, *[0] * len(names)]}, {"host": pa.string(), "name": pa.int64(), "pages": pa.int64(), "open_pages": pa.int64()})

    return run


def _hits(names: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places whose name is known, its place in the sorted ``known``)."""
    if not len(known) or not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    hit = np.flatnonzero(known[at] == names)
    return hit, at[hit]


def _counted(repeat: int):
    """For each shard of a host, with the host's candidates: the number of its pages that hold each, in any of their blocks and in open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, pages, names in ((h.as_py(), p.as_py(), n.as_py()) for b in batches for h, p, n in zip(*b.columns, strict=True)):
            s, left, page, opened = _streams(pages)
            known = np.unique(np.array(names, np.int64))
            hit, at = _hits(_names(s, repeat), known)
            at, hit = at[left[hit] >= repeat], hit[left[hit] >= repeat]
            every, some = _pages(at, page[hit], len(known)), _pages(at[opened[hit]], page[hit[opened[hit]]], len(known))
            held = np.flatnonzero(every)
            yield _table({"host": [host] * len(held), "name": known[held], "pages": every[held], "open_pages": some[held]}, {"host": pa.string(), "name": pa.int64(), "pages": pa.int64(), "open_pages": pa.int64()})

    return run


def covered(lengths: np.ndarray, ids: np.ndarray, known: np.ndarray, repeat: int, cover: float) -> np.ndarray:
    """Blocks of a stream whose tokens are covered to the share ``cover`` by runs with a name in the sorted ``known``."""
    hit, _ = _hits(_names(ids, repeat), known) if len(known) and len(ids) >= repeat else (ids[:0], None)
    if not len(hit):
        return np.zeros(0, np.int64)
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + repeat, -1)
    share = np.add.reduceat(np.cumsum(mark)[:-1] > 0, np.cumsum(lengths) - lengths, dtype=np.int64) / lengths
    return np.flatnonzero(share >= cover)


def _judged(repeat: int, cover: float):
    """For each shard of a host, with the host's boilerplate: (row, the open blocks that it covers, number of all blocks that it covers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages, every, some in ((p.as_py(), n.as_py(), o.as_py()) for b in batches for p, n, o in zip(*b.columns, strict=True)):
            known, known_open = np.sort(np.array(every, np.int64)), np.sort(np.array(some, np.int64))
            out: dict[str, list] = {"row": [], "gone": [], "n_repeated": []}
            s, left, page, _ = _streams(pages)
            hit, _ = _hits(_names(s, repeat), np.union1d(known, known_open))
            for row, ats, opened, rest in (unpacked(pages[i]) for i in np.flatnonzero(np.bincount(page[hit[left[hit] >= repeat]]))):
                gone = ats[covered(*opened, known_open, repeat, cover)]
                n = len(gone) + len(covered(*rest, known, repeat, cover))
                if n:
                    for c, v in zip(out, (row, gone.tolist(), n), strict=True):
                        out[c].append(v)
            yield _table(out, {"row": pa.int64(), "gone": pa.list_(pa.int32()), "n_repeated": pa.int64()})

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
        pages = [packed(row, blocks(page)) for row, page in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pages, pa.binary())], names=["row", "host", "page"])


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", repeat: int = REPEAT, share: float = PAGES, cover: float = COVER) -> DataFrame:
    """One row per page: id, url, text, n_chars, n_repeated.

    The suffix arrays go over all blocks of all pages. A block is a candidate if token runs of ``repeat`` tokens that each
    occur on a ``share`` of the host's pages (two at least) cover ``cover`` of its tokens; ``n_repeated`` is the number of a
    page's candidates, of menus and articles alike. Then the structure is looked at: an article's or main element's own
    candidates stay, so that a passage which other pages repeat is not lost, furniture goes whether or not it repeats, and
    open blocks go if they are candidates. For open blocks the share is one of the pages that have any, and counts only
    their open blocks. The runs go over block ends, so the items of a menu count together; open blocks are one stream of
    a page and the others a second one. A null page is empty. Pages with a null or unreadable url are one host, and equal
    rows are one page. Character references are decoded, white space in a block becomes one space, blocks are joined by
    one space in page order. Other columns are ignored.

    Streams hold 24 bits of each token's hash, so two runs that differ in one token are taken for one with a chance of
    1 in 17 million. A host's pages are dealt to shards; a run on a share of its pages is on that share of the pages of a
    shard, so only such runs leave a shard, and a second look at all shards counts them exactly. ``df`` is read three
    times: for the sizes of hosts, for the streams and for the texts, which are never shuffled unless the table of the
    pages with candidates is too large to broadcast.
    """
    read = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    read = read.withColumn("row", F.xxhash64("id", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    source = read.select("row", host.alias("host"), "html")
    shards = F.greatest(F.lit(1), F.least(F.ceil(F.sum(F.length("html")) / SHARD_CHARS), F.ceil(F.count("*") / SHARD_PAGES))).cast("int")
    hosts = stored(source.groupBy("host").agg(shards.alias("shards")))
    dealt = source.mapInArrow(trimmed(_packed), "row long, host string, page binary").where("page is not null").join(hosts, "host")
    dealt = dealt.groupBy("host", "shards", F.pmod(F.xxhash64("row"), F.col("shards")).alias("shard")).agg(F.collect_set("page").alias("pages"))
    dealt = stored(dealt.select("host", "shards", "pages"))
    local = stored(dealt.mapInArrow(trimmed(_local(repeat, share)), LOCAL))
    asked = local.where("name is not null").groupBy("host").agg(F.collect_set("name").alias("names"))
    counts = dealt.select("host", "pages").join(asked, "host").select("host", "pages", "names").mapInArrow(trimmed(_counted(repeat)), LOCAL)
    counts = counts.groupBy("host", "name").agg(F.sum("pages").alias("pages"), F.sum("open_pages").alias("open_pages"))
    sizes = local.where("name is null").groupBy("host").agg(F.sum("pages").alias("n"), F.sum("open_pages").alias("n_open"))
    least = lambda n: F.greatest(F.lit(2), F.ceil(F.col(n) * share - 1e-9))
    known = counts.join(sizes, "host").groupBy("host")
    known = stored(known.agg(F.collect_list(F.when(F.col("pages") >= least("n"), F.col("name"))).alias("every"), F.collect_list(F.when(F.col("open_pages") >= least("n_open"), F.col("name"))).alias("some")))
    gone = stored(dealt.select("host", "pages").join(known, "host").select("pages", "every", "some").mapInArrow(trimmed(_judged(repeat, cover)), "row long, gone array<int>, n_repeated long"))
    for t in (hosts, dealt, local, known):
        forget(t)
    out = read.select("id", "url", "html", "row").mapInArrow(trimmed(_read), "id long, url string, row long, parts array<string>").join(gone, "row", "left")
    kept = F.filter("parts", lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    out = out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join(kept, " ").alias("text"), F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"))
    return out.select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
