"""Semi-Markov conditional random field over short token windows (Sarawagi and Cohen, 2004), in numpy.

A segmentation is a run of single outside tokens and entity segments of at most ``MAX_TOKENS`` tokens. An entity
segment scores by features of the whole span; neighbouring segments add a transition weight between their types.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

TYPES = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
FEATURES, COMMON = 30, 23
#: How writers spell @ and . out, mask digits and announce extensions.
AT_WORDS, DOT_WORDS, EXTENSION = ("at", "At", "AT"), ("dot", "Dot", "DOT"), ("ext", "Ext", "x", "extension")
MASK = re.compile("x+|X+|[*#\u2022]")


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def span_features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Shape (n, MAX_TOKENS, FEATURES): features of the span of 1..MAX_TOKENS tokens from each token; padded past the end."""
    n = len(spans)
    words = [text[a:b] for a, b in spans]
    kind = np.array([0 if w[0].isascii() and w[0].isalpha() else 1 if w[0].isascii() and w[0].isdigit() else 2 for w in words])
    is_ = lambda s: np.array([w in s for w in words])
    at, dot, plus, space, dash, paren = (is_(s) for s in ("@", ".", "+", (" ", "\t", "\n", "\xa0"), "-", ("(", ")")))
    local = is_(("_", "%"))
    other = (kind == 2) & ~(at | dot | plus | space | dash | paren | local)
    digits = np.where(kind == 1, [len(w) for w in words], 0)
    run = lambda x: np.concatenate([[0], np.cumsum(x)])
    begin = np.arange(n)[:, None]
    end = np.minimum(begin + np.arange(1, MAX_TOKENS + 1), n)
    inside = lambda x: (c := run(x))[end] - c[begin]
    n_digit, n_letter, n_at, n_dot, n_plus, n_space, n_dash, n_paren, n_other = (inside(x) for x in (digits, kind == 0, at, dot, plus, space, dash, paren, other))
    n_local = inside(local)
    # Luhn over the span's digits by two running sums, one for each parity of doubling
    ds = np.array([int(c) for w, k in zip(words, kind, strict=True) if k == 1 for c in w], np.int64)
    twice = np.where(ds * 2 > 9, ds * 2 - 9, ds * 2)
    even = run(np.where(np.arange(len(ds)) % 2 == 0, twice, ds))
    odd = run(np.where(np.arange(len(ds)) % 2 == 1, twice, ds))
    upto = run(digits)
    q, p = upto[end], upto[begin]
    luhn = (np.where(q % 2 == 0, even[q] - even[p], odd[q] - odd[p]) % 10 == 0) & (n_digit > 0)
    octet = np.array([k == 1 and len(w) < 12 and int(w) <= 255 for w, k in zip(words, kind, strict=True)])
    quad = np.zeros((n, MAX_TOKENS), bool)
    for i in range(max(0, n - 6)):
        quad[i, 6] = octet[i] and dot[i + 1] and octet[i + 2] and dot[i + 3] and octet[i + 4] and dot[i + 5] and octet[i + 6]
    last = end - 1
    after_at = np.where(at, np.arange(n), -1)
    seen = np.maximum.accumulate(after_at)[last]
    domain_dots = np.where(seen >= begin, run(dot)[end] - run(dot)[np.maximum(seen, 0)], 0)
    edge_ok = np.where(begin > 0, ~(kind[begin - 1] < 2), True) & np.where(end < n, ~(kind[np.minimum(end, n - 1)] < 2), True)
    word_edges = (kind[begin] < 2) & (kind[last] < 2)
    # three runs of 3, 3 and 4 digits, with nothing but separators around them
    runs = inside(kind == 1)
    first_run = np.array([next((int(digits[j]) for j in range(i, min(i + 3, n)) if digits[j]), 0) for i in range(n)])[:, None]
    grouped = (runs == 3) & (n_digit == 10) & (first_run == 3) & (digits[last] == 4) & (n_letter + n_other + n_at + n_plus == 0)
    # spelled-out addresses: "a at b dot org" with single spaces, "a [at] b.org" in brackets
    is_at, is_dot = is_(AT_WORDS), is_(DOT_WORDS)
    opens, closes = is_(("[", "(", "{", "<")), is_(("]", ")", "}", ">"))
    before, after = np.concatenate([[False], opens[:-1]]), np.concatenate([closes[1:], [False]])
    n_word_at, n_word_dot, n_bracket_at = inside(is_at), inside(is_dot), inside(is_at & before & after)
    joint = opens | closes | is_at | is_dot
    beside = np.concatenate([[False], joint[:-1]]) | np.concatenate([joint[1:], [False]])
    n_loose = inside(space & ~beside)
    alnum = kind < 2
    tight = dot & np.concatenate([[False], alnum[:-1]]) & np.concatenate([alnum[1:], [False]])
    link = tight | dash | local
    whole = word_edges & ~joint[begin] & ~joint[last] & ~np.concatenate([[False], link[:-1]])[begin] & ~np.concatenate([link[1:], [False]])[last]
    spoken = (n_word_at == 1) & (n_word_dot >= 1) & (n_loose == 0) & (n_other + n_paren + n_at == 0) & (n_dot == inside(tight)) & whole
    bracketed = (n_bracket_at == 1) & (n_word_at == 1) & (n_at == 0) & (n_dot + n_word_dot >= 1) & (n_dot == inside(tight)) & (n_loose == 0) & whole
    # a card whose digits are partly masked: digits and mask signs from end to end, in all as many as a card has
    masked = np.array([len(w) if MASK.fullmatch(w) else 0 for w in words])
    shown = (kind == 1) | (masked > 0)
    shown_before, shown_after = np.concatenate([[False], shown[:-1]]), np.concatenate([shown[1:], [False]])
    n_mask = inside(masked)
    hidden = (n_mask >= 4) & (n_digit >= 2) & (n_digit + n_mask >= 13) & (n_digit + n_mask <= 19) & (inside(shown) + n_space + n_dash == end - begin) & shown[begin] & shown[last] & ~shown_before[begin] & ~shown_after[last]
    # four octets whose dots are bracketed or spelled out
    defanged = (runs == 4) & (inside(octet) == 4) & (n_space == 0) & (n_dot + n_word_dot == 3) & (n_letter == n_word_dot) & (n_dash + n_plus + n_at == 0) & (kind[begin] == 1) & (kind[last] == 1)
    # national numbers with a leading zero, international ones with two, and extensions
    zero, zeros = np.array([w[0] == "0" and k == 1 for w, k in zip(words, kind, strict=True)]), np.array([w.startswith("00") and k == 1 for w, k in zip(words, kind, strict=True)])
    plain = (n_letter + n_other + n_at + n_plus == 0) & (kind[last] == 1) & (n_digit >= 9) & (runs >= 2) & ((n_dot == 0) | (runs >= 4)) & (end - begin <= 2 * runs + n_paren)
    zero = zero & ~zeros  # one zero, then the area
    national = plain & (zero[begin] | opens[begin] & np.concatenate([zero[1:], [False]])[begin]) & (n_digit <= 13)
    extended = (inside(is_(EXTENSION)) == 1) & (n_letter == 1) & (n_digit >= 11) & (n_digit <= 15) & (runs == 4) & (kind[last] == 1) & (n_other - inside(is_((":",))) == 0)
    f = np.stack(
        [
            np.ones_like(n_digit), n_at == 1, (n_at == 1) & (domain_dots >= 1), n_space + n_other + n_paren > 0, (n_letter > 0), word_edges, quad, (n_digit >= 13) & (n_digit <= 19), luhn & (n_digit >= 13),
            plus[begin] & np.ones_like(quad), (n_digit >= 9) & (n_digit <= 15), (kind[last] == 1), edge_ok, n_dot > 0, n_digit > 0, n_other > 0, paren[begin] & (n_digit == 10), n_dash > 0, n_plus > 0,
            np.minimum(n_digit, 20) / 20, np.minimum(end - begin, MAX_TOKENS) / MAX_TOKENS, (n_at == 1) & (n_space + n_other + n_paren == 0) & (n_local >= 0), grouped,
            spoken, bracketed, hidden, defanged, national, plain & zeros[begin] & (n_digit <= 16), extended,
        ],
        axis=2,
    )
    f = f.astype(float)
    f[:, :, COMMON:] *= 3  # rare features decide alone and see few updates: larger values learn faster
    f[begin + np.arange(1, MAX_TOKENS + 1) > n] = 0
    return f


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class SemiCrf:
    """``w``: (types, features); ``t``: (types + 1, types + 1) transitions, outside last."""

    w: np.ndarray
    t: np.ndarray

    def scores(self, f: np.ndarray) -> np.ndarray:
        """(n, MAX_TOKENS, types + 1) segment scores; outside segments have one token and score 0."""
        n = len(f)
        s = np.full((n, MAX_TOKENS, len(TYPES) + 1), -np.inf)
        s[:, :, :-1] = f @ self.w.T
        s[:, 0, -1] = 0
        s[np.arange(n)[:, None] + np.arange(1, MAX_TOKENS + 1) > n] = -np.inf
        return s

    def decode(self, f: np.ndarray) -> list[tuple[int, int, int]]:
        """Best segmentation's entities as (first token, token end, type)."""
        s, n, k = self.scores(f), len(f), len(TYPES) + 1
        best, back = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k, 2), int)
        best[0, -1] = 0
        for i in range(n):
            into = best[i][:, None] + self.t
            m, origin = into.max(0), into.argmax(0)
            top = min(MAX_TOKENS, n - i)
            new = m + s[i, :top]
            better = new > best[i + 1 : i + top + 1]
            best[i + 1 : i + top + 1][better] = new[better]
            back[i + 1 : i + top + 1][better] = np.stack([np.full((top, k), i), np.broadcast_to(origin, (top, k))], 2)[better]
        out, j, y = [], n, int(best[n].argmax()) if n else k - 1
        while j > 0:
            i, before = back[j, y]
            if y < len(TYPES):
                out.append((int(i), j, y))
            j, y = int(i), int(before)
        return out[::-1]

    def gradient(self, f: np.ndarray, gold: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        s, n, k = self.scores(f), len(f), len(TYPES) + 1
        alpha, beta, ahead = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf), np.full((n, k), -np.inf)
        alpha[0, -1], beta[n] = 0, 0
        m = np.full((n, k), -np.inf)
        for j in range(n + 1):
            if j:
                lens = np.arange(1, min(MAX_TOKENS, j) + 1)
                alpha[j] = _lse(m[j - lens] + s[j - lens, lens - 1], 0)
            if j < n:
                m[j] = _lse(alpha[j][:, None] + self.t, 0)
        for i in range(n - 1, -1, -1):
            lens = np.arange(1, min(MAX_TOKENS, n - i) + 1)
            ahead[i] = _lse(s[i, lens - 1] + beta[i + lens], 0)
            beta[i] = _lse(self.t + ahead[i][None], 1)
        z = _lse(alpha[n], 0)
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        ends = np.minimum(np.arange(n)[:, None] + np.arange(1, MAX_TOKENS + 1), n)
        p = np.exp(m[:, None] + s + beta[ends] - z)
        gw -= np.einsum("nlk,nlf->kf", p[:, :, :-1], f)
        gt -= np.exp(alpha[:n, :, None] + self.t[None] + ahead[:, None] - z).sum(0)
        y, i = k - 1, 0
        todo = {a: (b, t) for a, b, t in gold}
        while i < n:
            b, t = todo.get(i, (i + 1, k - 1))
            if t < k - 1:
                gw[t] += f[i, b - i - 1]
            gt[y, t] += 1
            y, i = t, b
        return gw, gt


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 8, seed: int = 5) -> SemiCrf:
    """Adagrad ascent of the penalised log-likelihood; gold spans are (start, end, type) in characters of the window."""
    rng = np.random.default_rng(seed)
    model = SemiCrf(np.zeros((len(TYPES), FEATURES)), np.zeros((len(TYPES) + 1, len(TYPES) + 1)))
    model.w[:, 0] = -2
    ready = []
    for text, gold in windows:
        spans = tokens(text)
        starts, ends = {a: i for i, (a, _) in enumerate(spans)}, {b: i + 1 for i, (_, b) in enumerate(spans)}
        aligned = [(starts[a], ends[b], t) for a, b, t in gold if a in starts and b in ends and ends[b] - starts[a] <= MAX_TOKENS]
        if spans:
            ready.append((span_features(text, spans), aligned))
    sw, st = np.full_like(model.w, 1e-6), np.full_like(model.t, 1e-6)
    for _ in range(epochs):
        for i in rng.permutation(len(ready)):
            gw, gt = model.gradient(*ready[i])
            gw, gt = gw - 1e-4 * model.w, gt - 1e-4 * model.t
            sw, st = sw + gw**2, st + gt**2
            model.w, model.t = model.w + 0.5 * gw / np.sqrt(sw), model.t + 0.5 * gt / np.sqrt(st)
    return model
