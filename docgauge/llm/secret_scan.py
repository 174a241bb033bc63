"""Secret scanning: fixed rules plus a character convolutional network over every other candidate in its context."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm import charcnn
from docgauge.llm._common import forget, stored, trimmed

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A candidate is any run of 12 or more printable signs without those that part values, less outer sentence marks.
CANDIDATE = re.compile(r"[!#-&*+./0-9?@A-Z\\^_`a-z|~-]{12,}={0,2}")
OUTER = ".!?*#$%&|~`"
LEAST = 12
CONTEXT, CORE = 24, 48
LENGTH = 2 * CONTEXT + CORE
FINDINGS = 3000
#: Windows of one finding that training sees; scoring sees them all, so many at once.
PARTS, AT_ONCE = 8, 4096


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed rules in code points, end exclusive, by start and then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Long tokens of any kind of signs that no rule span touches."""
    out, k = [], 0
    taken = sorted((a, b) for _, a, b in taken)
    for m in CANDIDATE.finditer(text):
        token = m[0]
        a, b = m.start() + len(token) - len(token.lstrip(OUTER)), m.start() + len(token.rstrip(OUTER))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a >= LEAST and not any(c < b and d > a for c, d in taken[k : k + 3]):
            out.append((a, b))
    return out


def windows(spans: list[tuple[int, int]], most: int | None = None) -> Iterator[tuple[int, int, int]]:
    """Parts of at most ``CORE`` characters that cover the spans (the first ``most`` of each), with the span's number."""
    for i, (start, end) in enumerate(spans):
        for a in range(start, min(end, start + most * CORE) if most else end, CORE):
            yield a, min(a + CORE, end), i


def codes_of(text: str, spans: list[tuple[int, int]], begins: list[int] | None = None) -> tuple[np.ndarray, list[int]]:
    """Network input of the first ``PARTS`` windows of the spans, and the span of each; no context before ``begins``."""
    parts = list(windows(spans, PARTS))
    return charcnn.window_codes(text, [(a, b) for a, b, _ in parts], [begins[i] if begins else 0 for *_, i in parts], CONTEXT, LENGTH), [i for *_, i in parts]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


ALNUM = string.ascii_letters + string.digits
SYLLABLES = ["ing", "the", "ner", "ac", "tion", "ou", "mi", "re"]


def generated(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows in formats that the corpus may not hold: codes, secret or not, finding, and kind (its format's number)."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    codes, labels, finding, kinds = [], [], [], []
    for i in range(n):
        word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5)))
        secret = i % 2
        if secret:
            forms = [
                lambda: "ghp_" + pick(ALNUM, 36), lambda: "eyJ" + pick(ALNUM + "-_", 60), lambda: pick(ALNUM + "+/", 40), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(ALNUM, 24), lambda: "AIza" + pick(ALNUM + "-_", 35),
                lambda: pick(string.hexdigits, 32), lambda: "sk-" + pick(ALNUM, 40), lambda: pick(ALNUM + "!@#$%^&*", rng.randint(12, 20)), lambda: pick(string.ascii_letters, rng.randint(16, 32)), lambda: pick(string.digits, rng.randint(20, 32)),
                lambda: pick(string.ascii_lowercase, rng.randint(20, 32)), lambda: pick(string.ascii_uppercase + string.digits, rng.randint(16, 32)), lambda: pick(ALNUM, rng.randint(12, 20)) + f"@{word}.example.org",
            ]
        else:
            forms = [
                lambda: f"{word}.{pick(string.digits, 2)}.example.com/{word}", lambda: f"/{word}/{word}/{pick(string.digits, 4)}", lambda: f"{word}-{word}-{rng.randint(1, 2100)}", lambda: f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T12.30.00",
                lambda: f"{word}{rng.randint(0, 99)}.{word}.{word}", lambda: f"{word}_{word}_v{rng.randint(1, 40)}", lambda: word + word, lambda: f"{word}.{word}@{word}.example.org", lambda: (word + word).upper(), lambda: (word + word).capitalize(),
            ]
        kind = rng.randrange(len(forms))
        token = forms[kind]()
        text = f"{word} {rng.choice(['', 'key ', 'use ', 'see ', 'id = '])}{token} {word}"
        at = text.index(token)
        some, _ = codes_of(text, [(at, at + len(token))])
        codes.append(some)
        labels += [secret] * len(some)
        finding += [i] * len(some)
        kinds += [len(KINDS) + kind] * len(some)
    return np.concatenate(codes), np.array(labels), np.array(finding), np.array(kinds)


def labelled(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """The rules' findings, of an assignment the value, and where context begins: every other one has none before it."""
    values = [(max(a, b - len(re.search("[A-Za-z0-9+/_.=-]*$", text[a:b])[0])) if k == "assign" else a, b) for k, a, b in spans]
    return values, [0 if i % 2 else a for i, (a, _) in enumerate(values)]


def _findings(text: str) -> Iterator[tuple[int, int, str, bytes]]:
    """Findings of the rules (label 1) and other candidates (label 0): label, kind, token, codes of the first windows."""
    base = base_spans(text)
    rest = candidates(text, base)
    values, begins = labelled(text, base)
    for label, spans, starts in ((1, values, begins), (0, rest, None)):
        for lo in range(0, len(spans), AT_ONCE // PARTS):
            some = spans[lo : lo + AT_ONCE // PARTS]
            codes, owner = codes_of(text, some, starts[lo : lo + len(some)] if starts else None)
            cuts = np.searchsorted(owner, np.arange(len(some) + 1)).tolist()
            for i, (a, b) in enumerate(some):
                yield label, KINDS.index(base[lo + i][0]) if label else len(KINDS) - 1, text[a:b], codes[cuts[i] : cuts[i + 1]].tobytes()


def _samples(findings: int):
    """The ``findings`` of each class that come first by hash in a partition, as rows (label, kind, hash, token, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple]] = [{}, {}]

        def cut(room: int) -> None:
            for kind in (0, 1):
                if len(best[kind]) > room:
                    best[kind] = dict(sorted(best[kind].items())[:findings])

        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            for text in batch.column(1).to_pylist():
                for label, kind, token, codes in _findings(text or ""):
                    h = xxhash.xxh3_64_intdigest(codes)
                    if h not in best[label]:
                        best[label][h] = (kind, xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")), codes)
                        cut(20 * findings)
        cut(0)
        rows = [(label, kind, int(np.uint64(h).astype(np.int64)), int(np.uint64(t).astype(np.int64)), x) for label in (0, 1) for h, (kind, t, x) in best[label].items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["label", "kind", "hash", "token", "codes"])

    return run


def fit(texts: DataFrame, findings: int = FINDINGS, recall: float = 0.95) -> charcnn.CharCnn:
    """Train on at most ``findings`` findings of each class from all of the corpus (in hash order) plus generated ones.

    ``texts`` has the columns id and text. The threshold keeps ``recall`` of every kind of held-out finding: of each rule
    and of each generated format, drawn anew for it. Other candidates stand for the negative class, but for those that
    look like secrets to a network trained without their tokens. The first ``PARTS`` windows of a finding are trained on.
    """
    rows = stored(texts.mapInArrow(trimmed(_samples(findings)), "label int, kind int, hash long, token long, codes binary"))

    def first(label: int) -> list[tuple[int, int, np.ndarray]]:
        """The first findings by hash; a bound on the hash keeps what partitions send to the driver small."""
        mine = rows.where(F.col("label") == label).groupBy("hash").agg(F.min(F.struct("kind", "token", "codes")).alias("f")).select("hash", "f.*")
        n = mine.count()
        near = mine.where(F.col("hash") <= int(-(2**63) + min(2**64 - 1, 2**64 * 4 * findings // max(n, 1))))
        if near.count() >= min(findings, n):
            mine = near
        return [(r["kind"], r["token"], np.frombuffer(bytes(r["codes"]), np.uint8).reshape(-1, LENGTH)) for r in mine.orderBy("hash").limit(findings).collect()]

    pos, other = first(1), first(0)
    forget(rows)
    made, secret, made_finding, made_kind = generated(1500)
    fresh = generated(4000, 12)
    unseen = tuple(x[fresh[1] == 1] for x in (fresh[0], fresh[2] + 10**9, fresh[3]))

    def trained(negative: list[tuple[int, int, np.ndarray]]) -> charcnn.CharCnn:
        found = pos + negative
        sizes = [len(c) for *_, c in found]
        each = lambda values: np.repeat(np.array(list(values), np.int64), sizes)
        return charcnn.train(
            np.concatenate([made, *(c for *_, c in found)]).astype(np.int64), np.concatenate([secret, each(i < len(pos) for i in range(len(found)))]), recall,
            finding=np.concatenate([made_finding, each(range(len(made), len(made) + len(found)))]), token=np.concatenate([made_finding, each(t for _, t, _ in found)]),
            kind=np.concatenate([made_kind, each(k for k, *_ in found)]), unseen=unseen,
        )

    # unlabelled candidates may be secrets themselves: each half is judged by a network that has not seen its tokens
    halves = [[f for f in other if f[1] % 2 == k] for k in range(2)]
    clean = []
    for mine, rest in (halves, halves[::-1]):
        net = trained(rest)
        clean += [f for f in mine if net.probability(f[2]).max() < net.threshold]
    return trained(clean)


def found_in(net: charcnn.CharCnn, text: str) -> list[tuple[str, int, int]]:
    """All spans: the rules' own and the candidates of which a window reaches the network's threshold, by start and kind.

    However long a token is, ``AT_ONCE`` windows are held at once.
    """
    spans = base_spans(text)
    rest = candidates(text, spans)
    hit: set[int] = set()
    for some in batched(windows(rest), AT_ONCE):
        some = [w for w in some if w[2] not in hit]
        if some:
            low = max(0, some[0][0] - CONTEXT)
            codes = charcnn.window_codes(text[low : some[-1][1] + CONTEXT], [(a - low, b - low) for a, b, _ in some], [0] * len(some), CONTEXT, LENGTH)
            hit |= {some[k][2] for k in np.flatnonzero(net.probability(codes) >= net.threshold)}
    return sorted(spans + [("model", *rest[i]) for i in hit], key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: int = FINDINGS, recall: float = 0.95) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans (array of kind, start, end).

    One pass over the whole texts gathers the training windows, a second finds the spans; a null text is empty and has
    none. Rule spans always stay; the network adds spans of kind "model" among all tokens of ``LEAST`` or more signs that
    no rule touches, where the calibrated probability of any of a candidate's windows reaches the threshold. Repeated rows
    give repeated results; other columns are ignored.
    """
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    net = fit(base, findings, recall)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            every = [found_in(net, t or "") for t in batch.column(1).to_pylist()]
            fixed = [[s for s in spans if s[0] != "model"] for spans in every]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in fixed], pa.int64()) for k in KINDS[:3]]
            digest = pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in fixed], pa.string())
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in every], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return base.mapInArrow(trimmed(decide), f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans {SPANS}").withColumnRenamed("doc_id", id_col)


def span_text(spans: str = "spans"):
    """The digest form kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    out = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_text().alias("spans"))


def without_spans(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    parts, upto = [], 0
    for _, a, b in spans:
        if a >= upto:
            parts += [text[upto:a], mark]
        upto = max(upto, b)
    return "".join(parts) + text[upto:]


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every found span of its text replaced by ``mark``; n_chars, where there is one, follows.

    One pass fits the network, a second rewrites each row in place: no join, so null and repeated ids need no care.
    Overlapping spans share a mark; null texts stay null; all other columns and rows are as they were.
    """
    net = fit(df.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    at = df.columns.index(text_col)
    count = df.columns.index("n_chars") if "n_chars" in df.columns else None

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts = batch.column(at).to_pylist()
            spans = [found_in(net, t or "") for t in texts]
            new = [without_spans(t, s, mark) if s else t for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if count is not None:
                was = batch.column(count).to_pylist()
                columns[count] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, was, strict=True)]).cast(batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(trimmed(rewrite), df.schema)
