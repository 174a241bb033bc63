"""The network's threshold keeps the recall that it promises: by window, by finding, by kind, and on unseen formats."""

import random
import string
import tracemalloc

import numpy as np
import pytest

from docgauge.llm import charcnn, secret_scan

SF = "/root/testdata/sf0.01"


def test_threshold_keeps_recall_of_overlapping_classes():
    rng = np.random.default_rng(1)
    codes, y = rng.integers(1, 96, (600, 24)), (rng.random(600) < 0.3).astype(float)  # nothing to learn: low probabilities
    net = charcnn.train(codes, y, 0.95, epochs=2)
    held = np.random.default_rng(3).permutation(len(y))[: len(y) // 5][1::2]
    p = net.probability(codes[held][y[held] == 1])
    assert (p >= net.threshold).mean() >= 0.95


def test_threshold_of_the_hardest_kind():
    best, kind = np.concatenate([np.linspace(0.5, 1, 100), np.linspace(0.1, 0.2, 40), [0.01]]), np.array([0] * 100 + [1] * 40 + [2])
    t = charcnn.recalled(best, kind, 0.95)
    assert t == 0.01  # the few of kind 2 count as a kind of their own
    t = charcnn.recalled(best[:-1], kind[:-1], 0.95)
    assert (best[:100] >= t).mean() >= 0.95 and (best[100:140] >= t).mean() == 0.95 and charcnn.recalled(best[:0], kind[:0], 0.95) > 1


def test_findings_count_by_their_best_window_and_tokens_stay_on_one_side():
    assert [x.tolist() for x in charcnn.per_finding(np.array([0.1, 0.9, 0.4, 0.3]), np.array([7, 7, 2, 2]))] == [[2, 7], [0.4, 0.9]]
    rng = np.random.default_rng(2)
    codes, y = rng.integers(1, 96, (400, 24)), np.repeat([1.0, 0.0], 200)
    one = charcnn.train(codes, y, epochs=1, token=np.zeros(400, int))  # a single token: nothing is held out
    assert one.threshold > 1


@pytest.fixture(scope="module")
def net(spark):
    return secret_scan.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))


def token_found(net, token: str, before: str) -> bool:
    text = f"the {before}{token} word"
    at = text.index(token)
    return any(a < at + len(token) and b > at for _, a, b in secret_scan.found_in(net, text))


def test_recall_by_kind_on_seen_and_unseen_formats(net):
    rng = random.Random(2024)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    alnum = string.ascii_letters + string.digits
    forms = {
        "ghp": lambda: "ghp_" + pick(alnum, 36), "base64": lambda: pick(alnum + "+/", 40), "password": lambda: pick(alnum + "!@#$%^&*", rng.randint(12, 20)), "letters": lambda: pick(string.ascii_letters, rng.randint(16, 32)),
        "digits": lambda: pick(string.digits, rng.randint(20, 32)), "lower": lambda: pick(string.ascii_lowercase, 24), "credentials": lambda: pick(alnum, 16) + "@db.example.org",
        # formats kept out of training
        "glpat": lambda: "glpat-" + pick(alnum + "-_", 20), "npm": lambda: "npm_" + pick(alnum, 36), "hf": lambda: "hf_" + pick(string.ascii_letters, 34), "sg": lambda: "SG." + pick(alnum + "-_", 22) + "." + pick(alnum + "-_", 43),
    }
    recall = {name: np.mean([token_found(net, form(), rng.choice(["", "key ", "use ", "id is "])) for _ in range(200)]) for name, form in forms.items()}
    assert min(recall.values()) >= 0.9, recall


def test_few_clean_tokens_are_marked(net, spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]
    marked = tokens = 0
    for t in texts:
        tokens += len(secret_scan.candidates(t, secret_scan.base_spans(t)))
        marked += sum(s[0] == "model" for s in secret_scan.found_in(net, t))
    assert tokens > 1000 and marked <= 0.01 * tokens, (marked, tokens)


def test_a_token_of_ten_megabytes_is_read_in_steps(net):
    text = "see " + "lorem-ipsum_" * 850_000 + " end"
    tracemalloc.start()
    spans = secret_scan.found_in(net, text)
    list(secret_scan._findings(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) <= 1 and peak < 150e6, (spans, peak)
