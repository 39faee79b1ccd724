"""A linear-chain conditional random field over sparse binary features: training by likelihood, decoding by Viterbi."""

from __future__ import annotations

from collections.abc import Callable, Hashable

import numpy as np

#: Contexts whose scores a process keeps.
KEPT = 200_000


class LinearChain:
    """weights: feature -> one number per label; transitions: label x label; start: one per label."""

    def __init__(self, labels: tuple[str, ...], weights: dict[str, list[float]], transitions: np.ndarray, start: np.ndarray):
        self.labels, self.weights = labels, weights
        self.transitions, self.start = transitions.tolist(), start.tolist()
        self.kept: dict[Hashable, list[float]] = {}
        # What a token that is not labelled 0 can gain at most by the start and by the steps to it and from it, against all being 0.
        gain = max(0.0, float((transitions - transitions[0, 0]).max()))
        self.gain = 2 * gain + max(0.0, float((start - start[0]).max())) + 1e-6

    def scores(self, features: list[str]) -> list[float]:
        """What a token's features say for each label."""
        e = [0.0] * len(self.labels)
        for f in features:
            if (w := self.weights.get(f)) is not None:
                for k in range(len(e)):
                    e[k] += w[k]
        return e

    def kept_scores(self, context: Hashable, described: Callable[[Hashable], list[str]]) -> list[float]:
        """The scores of described(context), computed once; at most KEPT contexts are kept at a time."""
        if (e := self.kept.get(context)) is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            e = self.kept[context] = self.scores(described(context))
        return e

    def decode(self, sequence: list[list[str]], allowed: list[bool]) -> list[int]:
        """The most likely labels; a token that is not allowed is labelled 0."""
        return self.viterbi([self.scores(fs) for fs in sequence], allowed)

    def best_of(self, scored: list[list[float]], paths: tuple[list[int], ...]) -> list[int]:
        """The most likely of these labellings."""
        total = lambda y: self.start[y[0]] + sum(e[k] for e, k in zip(scored, y, strict=True)) + sum(self.transitions[a][b] for a, b in zip(y, y[1:], strict=False))
        return max(paths, key=total)

    def viterbi(self, scored: list[list[float]], allowed: list[bool]) -> list[int]:
        """The most likely labels by the scores of each token; where no allowed token can make up for what it loses against 0, all are 0."""
        if all(max(e[1:]) - e[0] + self.gain < 0 for e, ok in zip(scored, allowed, strict=True) if ok):
            return [0] * len(scored)
        n = len(self.labels)
        best: list[float] = []
        back: list[list[int]] = []
        for e, ok in zip(scored, allowed, strict=True):
            if not ok:
                e = e[:]
                e[1:] = [-1e9] * (n - 1)
            if not best:
                best = [self.start[k] + e[k] for k in range(n)]
                continue
            now, at = [], []
            for k in range(n):
                scores = [best[j] + self.transitions[j][k] for j in range(n)]
                j = scores.index(max(scores))
                now.append(scores[j] + e[k])
                at.append(j)
            best = now
            back.append(at)
        if not best:
            return []
        out = [best.index(max(best))]
        for at in reversed(back):
            out.append(at[out[-1]])
        return out[::-1]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def fit(sequences: list[list[list[str]]], gold: list[list[int]], labels: tuple[str, ...], rounds: int = 100, l2: float = 0.1, rate: float = 0.3) -> LinearChain:
    """Maximum penalised likelihood by full-batch AdaGrad; forward and backward run over all sequences of about one length at once."""
    names = sorted({f for s in sequences for t in s for f in t})
    index = {f: i for i, f in enumerate(names)}
    k = len(labels)
    parts: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        if s:
            parts.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
    batches = [_Batch([sequences[i] for i in own], [gold[i] for i in own], index, k) for own in parts.values()]
    w, tr, st = np.zeros((len(names), k)), np.zeros((k, k)), np.zeros(k)
    square = [np.full_like(p, 1e-2) for p in (w, tr, st)]
    for _ in range(rounds):
        gradients = [l2 * w, l2 * tr, l2 * st]
        for b in batches:
            for total, g in zip(gradients, b.gradients(w, tr, st), strict=True):
                total += g
        for x, g, s in zip((w, tr, st), gradients, square, strict=True):
            s += g * g
            x -= rate * g / np.sqrt(s)
    return LinearChain(labels, {f: w[i].tolist() for f, i in index.items()}, tr, st)


class _Batch:
    """Sequences of about one length, padded to the longest."""

    def __init__(self, sequences: list[list[list[str]]], gold: list[list[int]], index: dict[str, int], k: int):
        self.n, self.length, self.k = len(sequences), max(map(len, sequences)), k
        # a token's features as one row of their numbers; equal tokens once
        rows: dict[tuple[int, ...], int] = {}
        self.row_of = np.zeros((self.n, self.length), int)
        for i, s in enumerate(sequences):
            for t, fs in enumerate(s):
                self.row_of[i, t] = rows.setdefault(tuple(index[f] for f in fs), len(rows))
        self.rows = len(rows)
        self.entry_row = np.array([r for fs, r in rows.items() for _ in fs])
        self.entry_feature = np.array([f for fs in rows for f in fs])
        y = np.zeros((self.n, self.length), int)
        for i, g in enumerate(gold):
            y[i, : len(g)] = g
        self.mask = np.arange(self.length)[None, :] < np.array([len(s) for s in sequences])[:, None]
        self.onehot = np.eye(k)[y] * self.mask[:, :, None]
        self.true = np.zeros((k, k))
        np.add.at(self.true, (y[:, :-1][self.mask[:, 1:]], y[:, 1:][self.mask[:, 1:]]), 1)

    def gradients(self, w: np.ndarray, tr: np.ndarray, st: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, mask = self.k, self.mask
        by_row = np.stack([np.bincount(self.entry_row, w[self.entry_feature, j], self.rows) for j in range(k)], axis=1)
        e = by_row[self.row_of] * mask[:, :, None]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = st + e[:, 0]
        for t in range(1, self.length):
            step = _logsumexp(a[:, t - 1, :, None] + tr, 1) + e[:, t]
            a[:, t] = np.where(mask[:, t, None], step, a[:, t - 1])
        z = _logsumexp(a[:, -1], 1)
        for t in range(self.length - 2, -1, -1):
            step = _logsumexp(tr + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(mask[:, t + 1, None], step, 0)
        p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
        joint = np.zeros((k, k))
        for t in range(self.length - 1):
            x = np.exp(a[:, t, :, None] + tr + (e[:, t + 1] + b[:, t + 1])[:, None, :] - z[:, None, None])
            joint += x[mask[:, t + 1]].sum(axis=0)
        d = p - self.onehot
        rows = np.stack([np.bincount(self.row_of.ravel(), d[:, :, j].ravel(), self.rows) for j in range(k)], axis=1)
        gw = np.stack([np.bincount(self.entry_feature, rows[self.entry_row, j], len(w)) for j in range(k)], axis=1)
        return gw, joint - self.true, d[:, 0].sum(axis=0)
