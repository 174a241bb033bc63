"""Personal data: fixed rules plus a semi-Markov conditional random field over windows around digits, @, + and spelled-out addresses."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm import semicrf
from docgauge.llm._common import forget, stored, trimmed
from docgauge.llm.secret_scan import joined, span_text

KINDS = semicrf.TYPES
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, and runs are taken whole, so no retry inside a run is needed.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Windows lie around these: digits, @, +, and the words that stand for @ and dots in an address.
TRIGGER = re.compile(r"[@+]|[0-9]+|[\[({<]\x20?(?:at|dot)\x20?[\])}>]|\x20(?:at\x20[A-Za-z0-9-]{1,40}\x20)?dot\x20", re.IGNORECASE)
NEAR, MARGIN = 24, 20
#: Longer regions are decoded in steps of CUT characters that look LOOK further, more than an entity of 24 tokens has.
CUT, LOOK = 1500, 400
#: Training windows of each class, and characters of the longest one.
SAMPLE, LONGEST = 600, 400
#: Windows in forms that the corpus may not hold.
GENERATED = 1000


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: from each @ back over local characters, never into the match before."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules in code points, end exclusive, by kind and then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(d) <= 3 and int(d or "0") <= 255 for d in (p.lstrip("0") for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Windows around every trigger, widened to white space; none touch, so no character is scored twice."""
    merged: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if merged and m.start() - merged[-1][1] <= NEAR:
            merged[-1][1] = m.end()
        else:
            merged.append([m.start(), m.end()])
    out: list[tuple[int, int]] = []
    for a, b in merged:
        low, high = max(0, a - MARGIN), min(len(text), b + MARGIN)
        while low > 0 and a - low < 3 * MARGIN and not text[low - 1].isspace():
            low -= 1
        while high < len(text) and high - b < 3 * MARGIN and not text[high].isspace():
            high += 1
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def pieces(text: str) -> Iterator[tuple[int, int, str]]:
    """(offset, characters of its own, characters) of the regions; a long one in steps that see beyond their own part."""
    for a, b in regions(text):
        while b - a > CUT:
            cut = max(text.rfind(" ", a, a + CUT), text.rfind("\n", a, a + CUT)) + 1
            cut = cut if cut > a else a + CUT
            yield a, cut - a, text[a : min(b, cut + LOOK)]
            a = cut
        yield a, b - a, text[a:b]


def gold(spans: list[tuple[str, int, int]], offset: int, length: int) -> list[tuple[int, int, int]]:
    """Rule spans inside a window as labels, the longer first where they overlap."""
    out: list[tuple[int, int, int]] = []
    for k, a, b in sorted(spans, key=lambda s: s[1] - s[2]):
        if a >= offset and b <= offset + length and not any(a - offset < d and b - offset > c for c, d, _ in out):
            out.append((a - offset, b - offset, KINDS.index(k)))
    return sorted(out)


def drawn(rng: random.Random) -> tuple[dict[str, list[str]], list[str]]:
    """One draw of every form that the rules miss, by kind, and of near misses that are no personal data."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    octet = lambda: str(rng.randint(0, 255))
    name = lambda: "".join(rng.choice(["an", "el", "mi", "ro", "ka", "jo", "ter", "len"]) for _ in range(rng.randint(2, 3)))
    user, host, tld = rng.choice([name(), f"{name()}.{name()}", f"{name()}{d(2)}"]), rng.choice([name(), f"{name()}-{name()}"]), rng.choice(["org", "com", "net", "de"])
    ips = [octet() for _ in range(4)]
    area = rng.choice("23456789") + d(2)
    mask = rng.choice(["x", "X", "*"]) * 4
    sep = rng.choice([" ", "-"])
    forms = {
        "email": [f"{user} [at] {host}.{tld}", f"{user}(at){host}.{tld}", f"{name()} at {host} dot {tld}", f"{user} [at] {host} [dot] {tld}"],
        "ip": ["[.]".join(ips), "(.)".join(ips), "(dot)".join(ips)],
        "card": [sep.join([d(4), mask, mask, d(4)]), sep.join([mask, mask, mask, d(4)]), d(6) + mask[0] * 6 + d(4)],
        "phone": [
            f"({area}) {d(3)}-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area} {d(3)} {d(4)}", f"0{area} {d(4)} {d(4)}", f"0{area[0]} {d(2)} {d(2)} {d(2)} {d(2)}", f"(0{area[:2]}) {d(4)} {d(4)}",
            f"00{area[:2]} {d(3)} {d(7)}", f"{area}-{d(3)}-{d(4)} ext {d(2)}",
        ],
    }
    near = [
        f"{d(4)}-{d(2)}-{d(2)}", f"{d(3)},{d(3)},{d(3)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(2)} + {d(2)}", f"{d(5)}", f"@{d(2)}abc", f"{d(2)}:{d(2)}:{d(2)}", f"{area}{d(1)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(3)} {d(3)}",
        f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(1)}. {d(1)}. {d(1)}. {d(1)}", f"0.{d(9)}", f"at {d(2)} dot matrix", f"{name()} at {d(2)}.{d(2)}", f"*** {name()} {d(2)} ***", f"0{d(1)}-0{d(1)}-{d(4)}", f"[{d(1)}] [{d(2)}] [{d(1)}]",
        f"({name()} at {host}) {d(4)}", f"0{d(1)}:{d(2)} {d(2)}:{d(2)}", f"0x{d(4)}", f"xxx {d(4)} xxx", f"{d(4)}x{d(4)}", "dot " * rng.randint(2, 12) + "dot", f"{name()} dot {name()} dot {name()}",
    ]
    return forms, near


def generated(n: int, seed: int = 13) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled windows in forms that the rules miss, every form alike, and as many near misses that are not personal."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        forms, near = drawn(rng)
        kind, body = rng.choice([(k, f) for k, fs in forms.items() for f in fs]) if i % 2 else (None, rng.choice(near))
        text = f"{rng.choice(['call', 'the', 'to', 'was', 'write', 'from'])} {body} {rng.choice(['and', 'or', 'in', 'now'])}"
        at = text.index(body)
        out.append((text, [(at, at + len(body), KINDS.index(kind))] if kind else []))
    return out


SCAN = pa.schema(
    [("doc_id", pa.int64()), ("base", pa.string()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("pieces", pa.list_(pa.struct([("at", pa.int64()), ("own", pa.int32()), ("chars", pa.string())])))]
)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = base_spans(text or "")
            base = joined(spans)
            rows.append((doc_id, base, *[sum(s[0] == k for s in spans) for k in KINDS], hashlib.sha256(base.encode()).hexdigest(), [{"at": a, "own": n, "chars": c} for a, n, c in pieces(text or "")]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCAN, strict=True)] if rows else [pa.array([], f.type) for f in SCAN], schema=SCAN)


def parsed(base: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]


def fit(scanned: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> semicrf.SemiCrf:
    """Train on at most ``sample`` windows that hold a rule span and as many that hold none (in hash order), plus ``GENERATED`` ones.

    Windows of ``longest`` or more characters are not trained on; all are decoded.
    """
    each = scanned.select("base", F.explode("pieces").alias("p")).select("base", "p.at", "p.chars")
    pick = lambda df: df.orderBy(F.xxhash64("chars"), "chars", "base", "at").limit(sample).collect()
    rows = pick(each.where(f"base <> '' and length(chars) < {longest}").dropDuplicates(["chars"])) + pick(each.where(f"base = '' and length(chars) < {longest}").dropDuplicates(["chars"]))
    return semicrf.train([(r["chars"], gold(parsed(r["base"]), r["at"], len(r["chars"]))) for r in rows] + generated(GENERATED))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (array of kind, start, end).

    Every text is read whole, once; a null text is empty. Rule spans always stay; the random field adds the entities of
    its best segmentation that overlap no rule span. Repeated rows give repeated results; other columns are ignored.
    """
    scanned = stored(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(trimmed(scan), "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, pieces array<struct<at:long,own:int,chars:string>>"))
    model = fit(scanned, sample)
    keep = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, parts in zip(batch.column("base").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                fixed = parsed(base)
                every = list(fixed)
                done = 0
                for p in parts:
                    toks = semicrf.tokens(p["chars"])
                    for i, j, y in model.decode(semicrf.span_features(p["chars"], toks)) if toks else []:
                        a, b = p["at"] + toks[i][0], p["at"] + toks[j - 1][1]
                        if toks[i][0] < p["own"] and a >= done:  # what begins in the next step's part is found there
                            done = b
                            if not any(a < d and b > c for _, c, d in fixed):
                                every.append((KINDS[y], a, b))
                every.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in every])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=[*keep, "spans"])

    # the stored table is small beside the work on it: at least as many tasks as wrote it, each a file
    spread = scanned.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(scanned.inputFiles())))
    out = stored(spread.mapInArrow(trimmed(decide), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<kind:string,start:long,end:long>>"))
    forget(scanned)
    return out.withColumnRenamed("doc_id", id_col)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    out = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", span_text().alias("spans"))
