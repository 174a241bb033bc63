"""Recall of the random field by type, on forms that it was trained on and on forms kept out of training; near misses and clean text stay."""

import random
from collections import Counter

import pytest

from docgauge.llm import pii, semicrf

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text")
    return pii.fit(docs.mapInArrow(pii.scan, "doc_id long, base string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, pieces array<struct<at:long,own:int,chars:string>>"))


def found(model, text: str) -> list[tuple[int, int, str]]:
    out = []
    for at, own, chars in pii.pieces(text):
        toks = semicrf.tokens(chars)
        out += [(at + toks[i][0], at + toks[j - 1][1], pii.KINDS[y]) for i, j, y in model.decode(semicrf.span_features(chars, toks)) if toks[i][0] < own]
    return out


def unseen(rng: random.Random) -> dict[str, list[str]]:
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    user, host = rng.choice(["maria", "j.weber", "tom42"]), rng.choice(["posteo", "my-mail", "uni"])
    return {
        "email": [f"{user} AT {host} DOT edu", f"{user}{{at}}{host}.fr", f"{user} <at> {host}.it"],
        "ip": ["[dot]".join(str(rng.randint(0, 255)) for _ in range(4))],
        "card": [f"#### #### #### {d(4)}", f"{d(4)} XXXXXX {d(5)}"],
        "phone": [f"0151 {rng.randint(2, 9)}{d(7)}", f"0{rng.randint(2, 9)}{d(1)}-{d(4)}-{d(4)}", f"0049-{d(2)}-{d(7)}", f"{rng.randint(2, 9)}{d(2)}-{d(3)}-{d(4)} x{d(3)}"],
    }


def test_recall_by_type(model):
    rng = random.Random(31)
    for forms_of in (lambda: pii.drawn(rng)[0], lambda: unseen(rng)):
        hit, every = Counter(), Counter()
        for _ in range(60):
            for kind, forms in forms_of().items():
                for body in forms:
                    text = f"please note {body} today"
                    every[kind] += 1
                    hit[kind] += (12, 12 + len(body), kind) in found(model, text)
        assert set(every) == set(pii.KINDS) and all(hit[k] >= 0.9 * every[k] for k in every), (hit, every)


def test_near_misses_and_prose_stay(model):
    rng = random.Random(32)
    drawn = [body for _ in range(60) for body in pii.drawn(rng)[1]]
    assert sum(bool(found(model, f"please note {b} today")) for b in drawn if not pii.base_spans(b)) <= 0.05 * len(drawn)
    for text in ("meet me at noon", "we arrived at 10 dot five", "look at the [at] sign", "x at y", "a dot on the map", "chapter 3. 4. 5. 6. 7", "**** four stars ****", "(at) [at] {at}", " dot " * 50, "at " * 50):
        assert found(model, text) == [], text


def test_corpus_gains_few_spans(spark):
    """What the field adds to the rules on the given documents is under one in a hundred of them."""
    rows = pii.op8_pii(spark, SF).collect()
    more = [r for r in rows if len([s for s in r.spans.split(",") if s]) > r.n_email + r.n_ip + r.n_card + r.n_phone]
    assert len(rows) == 1000 and len(more) <= 10
