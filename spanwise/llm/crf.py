"""A linear-chain conditional random field over three labels, in numpy: learning and decoding.

Each position has a fixed number of active features; its score for a label is the sum of their
weights. Before the first and after the last position stands the label OUTSIDE.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
LABELS = 3


@dataclass(frozen=True)
class Chain:
    """Weights of features (features x labels) and of label pairs (from x to)."""

    weights: np.ndarray
    transitions: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Label scores of each position (positions x features -> positions x labels)."""
        out = self.weights[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            out += self.weights[features[:, k]]
        return out


def likelihood(chain: Chain, features: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed log-probability of the labels of padded sequences, and its gradients.

    ``features`` is sequences x steps x features, ``labels`` sequences x steps; what lies beyond
    a sequence's length is ignored. Forward and backward sums run over all sequences at once,
    scaled at each step.
    """
    n, steps, width = features.shape
    t, rows, last = chain.transitions, np.arange(n), lengths - 1
    emit = chain.scores(features.reshape(-1, width)).reshape(n, steps, LABELS).astype(np.float64)
    valid = np.arange(steps)[None, :] < lengths[:, None]
    top = emit.max(axis=2, keepdims=True)
    e, a = np.exp(emit - top), np.exp(t)
    alpha, beta, scale = np.empty_like(e), np.zeros_like(e), np.empty((n, steps))
    now = a[OUTSIDE] * e[:, 0]
    for i in range(steps):
        now = now if i == 0 else (now @ a) * e[:, i]
        scale[:, i] = now.sum(axis=1)
        now = now / scale[:, i, None]
        alpha[:, i] = now
    leave = alpha[rows, last] @ a[:, OUTSIDE]
    seen = np.zeros((LABELS, LABELS))
    ending = a[:, OUTSIDE] / leave[:, None]
    for i in range(steps - 1, -1, -1):
        beta[:, i] = np.where((last == i)[:, None], ending, 0.0)
        if i < steps - 1:
            on = last > i
            ahead = e[on, i + 1] * beta[on, i + 1] / scale[on, i + 1, None]
            beta[on, i] = ahead @ a.T
            seen += a * (alpha[on, i].T @ ahead)
    share = alpha * beta
    seen[OUTSIDE] += share[:, 0].sum(axis=0)
    seen[:, OUTSIDE] += share[rows, last].sum(axis=0)

    off = -share
    off[rows[:, None], np.arange(steps)[None, :], labels] += 1.0
    off[~valid] = 0.0
    grad = np.zeros(chain.weights.shape)
    for k in range(width):
        for y in range(LABELS):
            grad[:, y] += np.bincount(features[..., k].reshape(-1), weights=off[..., y].reshape(-1), minlength=len(grad))
    before = np.concatenate((np.full((n, 1), OUTSIDE), labels[:, :-1]), axis=1)
    pairs = np.zeros((LABELS, LABELS))
    np.add.at(pairs, (before[valid], labels[valid]), 1.0)
    np.add.at(pairs, (labels[rows, last], np.full(n, OUTSIDE)), 1.0)

    whole = (np.log(scale) + top[..., 0])[valid].sum() + np.log(leave).sum()
    scored = np.take_along_axis(emit, labels[..., None], 2)[..., 0][valid].sum()
    return float(scored + (pairs * t).sum() - whole), grad, pairs - seen


def learn(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, size: int, rounds: int = 60, rate: float = 0.3, decay: float = 0.02) -> Chain:
    """Penalised maximum likelihood by ``rounds`` full-batch steps with adapted step widths (Adam)."""
    flat = np.zeros((size + LABELS, LABELS))
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, rounds + 1):
        _, grad, pairs = likelihood(Chain(flat[:size], flat[size:]), features, labels, lengths)
        g = (np.concatenate((grad, pairs)) - decay * flat) / len(lengths)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        flat = flat + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain(flat[:size], flat[size:])


def best_labels(chain: Chain, emit: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The likeliest labels (Viterbi) of sequences laid end to end; ``ends`` are their exclusive ends.

    A position whose OUTSIDE score leads by more than twice the span of the transitions is
    OUTSIDE on every best path: changing its label to OUTSIDE would gain more than its two
    transitions can lose. Such positions cut the sequences; only the stretches between them are
    decoded, all at once, step by step. Of equal paths the one with smaller labels at the end wins.
    """
    out = np.zeros(len(emit), dtype=np.int8)
    t = chain.transitions
    slack = 2 * (t.max() - t.min())
    open_ = np.flatnonzero(emit[:, OUTSIDE] - emit[:, 1:].max(axis=1) <= slack)
    if not len(open_):
        return out
    owner = np.searchsorted(ends, open_, side="right")
    fresh = np.concatenate(([True], (np.diff(open_) > 1) | (np.diff(owner) > 0)))
    begin = np.flatnonzero(fresh)
    length = np.diff(np.append(begin, len(open_)))
    order = np.argsort(-length, kind="stable")
    begin, length = open_[begin[order]], length[order]
    score = t[OUTSIDE] + emit[begin].astype(np.float64)
    back: list[np.ndarray] = []
    final = np.empty((len(begin), LABELS))
    for i in range(1, int(length[0]) + 1):
        live = int(np.searchsorted(-length, -i, side="left"))  # stretches longer than i
        final[live : len(score)] = score[live:] + t[:, OUTSIDE]
        if not live:
            break
        step = score[:live, :, None] + t[None]
        back.append(step.argmax(axis=1).astype(np.int8))
        score = step.max(axis=1) + emit[begin[:live] + i]
    label = final.argmax(axis=1).astype(np.int8)
    out[begin + length - 1] = label
    for i in range(int(length[0]) - 1, 0, -1):
        live = len(back[i - 1])
        here = np.flatnonzero(length[:live] > i)
        label[here] = back[i - 1][here, label[here]]
        out[begin[here] + i - 1] = label[here]
    return out
