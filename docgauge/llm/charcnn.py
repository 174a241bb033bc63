"""A small character convolutional network in numpy: embedding, one convolution, max pooling, logistic output."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 5
PAD = 96


def window_codes(text: str, marks: list[tuple[int, int]], begins: list[int], context: int, length: int) -> np.ndarray:
    """Codes of shape (n, length) of marked parts with up to ``context`` characters on both sides, none before ``begins``.

    Printable ASCII is 1..95, anything else 96, past the end 0; +97 inside the marked part.
    """
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((raw >= 32) & (raw < 127), raw - 31, PAD).astype(np.uint8)
    start, end = np.array(marks, np.int64).reshape(-1, 2).T
    left = np.maximum(start - context, np.array(begins, np.int64))
    at = left[:, None] + np.arange(length)
    inside = at < np.minimum(end + context, len(code))[:, None]
    out = np.where(inside, code[np.minimum(at, len(code) - 1)], 0).astype(np.uint8)
    out[(at >= start[:, None]) & (at < end[:, None])] += PAD + 1
    return out


@dataclass
class CharCnn:
    """Weights; ``threshold`` and the Platt pair (slope, shift) come from held-out findings."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def hidden(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.emb[codes]
        x = np.concatenate([e[:, k : codes.shape[1] - WIDTH + 1 + k] for k in range(WIDTH)], axis=2)
        h = x @ self.conv + self.bias
        top = h.argmax(1)
        return x, np.maximum(np.take_along_axis(h, top[:, None], 1)[:, 0], 0), top

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """The convolution as a sum of one table a place: what a code adds to each filter."""
        tables = [(self.emb @ self.conv[k * self.emb.shape[1] : (k + 1) * self.emb.shape[1]]).astype(np.float32) for k in range(WIDTH)]
        tables[0] = tables[0] + self.bias.astype(np.float32)
        out = [np.zeros(0)]
        for i in range(0, len(codes), 256):
            c = codes[i : i + 256]
            h = tables[0][c[:, : c.shape[1] - WIDTH + 1]]
            for k in range(1, WIDTH):
                h += tables[k][c[:, k : c.shape[1] - WIDTH + 1 + k]]
            out.append(np.maximum(h.max(1), 0) @ self.out + self.shift)
        return np.concatenate(out)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(codes) + b, -30, 30)))


#: A kind with fewer held-out findings shares one threshold with the other such kinds.
FEWEST = 20


def recalled(best: np.ndarray, kind: np.ndarray, recall: float) -> float:
    """The largest threshold that keeps ``recall`` of the findings of every kind; above 1 without findings."""
    sizes = dict(zip(*np.unique(kind, return_counts=True), strict=True))
    kind = np.array([k if sizes[k] >= FEWEST else -1 for k in kind])
    return min((float(np.sort(best[kind == k])[int((1 - recall) * (kind == k).sum())]) for k in np.unique(kind)), default=1.1)


def per_finding(values: np.ndarray, finding: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The findings, and the largest of each one's windows' values."""
    names, at = np.unique(finding, return_inverse=True)
    best = np.full(len(names), -np.inf)
    np.maximum.at(best, at, values)
    return names, best


def train(
    codes: np.ndarray, y: np.ndarray, recall: float = 0.95, filters: int = 16, dim: int = 8, epochs: int = 10, seed: int = 3,
    finding: np.ndarray | None = None, token: np.ndarray | None = None, kind: np.ndarray | None = None, unseen: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
) -> CharCnn:
    """Adam on four fifths of the tokens; Platt scaling on half of the rest and the threshold on the other half.

    All windows of one ``token`` lie on one side. A ``finding`` counts by its best window, and the threshold is the
    largest that keeps ``recall`` of the held-out findings of every ``kind``, however low that is; ``unseen`` adds
    positive windows (codes, finding, kind) to those that set it. By default each window is a finding and a token.
    """
    rng = np.random.default_rng(seed)
    finding = np.arange(len(y)) if finding is None else finding
    tokens, side = np.unique(finding if token is None else token, return_inverse=True)
    drawn = rng.permutation(len(tokens))
    part = np.zeros(len(tokens), int)
    held_out = drawn[: len(tokens) // 5]
    part[held_out[::2]], part[held_out[1::2]] = 1, 2
    fit, scale, held = (np.flatnonzero(part[side] == k) for k in range(3))
    net = CharCnn(rng.normal(0, 0.3, (2 * PAD + 2, dim)), rng.normal(0, 0.2, (WIDTH * dim, filters)), np.zeros(filters), rng.normal(0, 0.2, filters), 0.0)
    names = ("emb", "conv", "bias", "out", "shift")
    first, second, t = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), 64):
            rows = fit[i : i + 64]
            c = codes[rows]
            x, pooled, top = net.hidden(c)
            d = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -30, 30))) - y[rows]) / len(rows)
            back = d[:, None] * net.out * (pooled > 0)
            grad = {"out": pooled.T @ d, "shift": d.sum(), "bias": back.sum(0), "conv": np.zeros_like(net.conv), "emb": np.zeros_like(net.emb)}
            picked = np.take_along_axis(x, top[:, :, None], 1)
            grad["conv"] = np.einsum("nfd,nf->df", picked, back)
            into = (back[:, :, None] * net.conv.T[None]).reshape(len(rows), filters, WIDTH, dim)
            at = c[np.arange(len(rows))[:, None, None], top[:, :, None] + np.arange(WIDTH)]
            np.add.at(grad["emb"], at.ravel(), into.reshape(-1, dim))
            t += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grad[n]
                second[n] = 0.999 * second[n] + 0.001 * grad[n] ** 2
                setattr(net, n, getattr(net, n) - 0.01 * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8))
    z, target = net.logits(codes[scale]), y[scale]
    a, b = 1.0, 0.0
    for _ in range(300):
        d = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - target
        a, b = a - 0.05 * float((d * z).mean()) if len(z) else a, b - 0.05 * float(d.mean()) if len(z) else b
    net.platt = (max(a, 1e-3), b)
    held = held[y[held] == 1]
    _, best = per_finding(net.probability(codes[held]), finding[held])
    kinds = np.zeros(len(best), int) if kind is None else kind[held][np.unique(finding[held], return_index=True)[1]]
    if unseen:
        _, best_more = per_finding(net.probability(unseen[0]), unseen[1])
        kinds, best = np.concatenate([kinds, unseen[2][np.unique(unseen[1], return_index=True)[1]]]), np.concatenate([best, best_more])
    net.threshold = recalled(best, kinds, recall)
    return net
