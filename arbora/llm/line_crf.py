"""A linear-chain conditional random field with two labels, boilerplate (0) and content (1), over the lines of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class LineCRF:
    emit: np.ndarray  # weight of each feature for content against boilerplate
    move: np.ndarray  # 2 x 2: score of going from one label to the next


def _padded(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as rows of one table, and which cells are filled."""
    n = np.diff(bounds)
    out = np.zeros((len(n), max(int(n.max(initial=0)), 1)) + x.shape[1:], x.dtype)
    filled = np.arange(out.shape[1]) < n[:, None]
    out[filled] = x
    return out, filled


def train(x: np.ndarray, y: np.ndarray, bounds: np.ndarray, steps: int = 200, rate: float = 0.15, l2: float = 1e-3, chain: bool = True) -> LineCRF:
    """Conditional likelihood by Adam: x lines by features, y a weak label for each line, bounds of the sequences."""
    seq, on = _padded(x, bounds)
    lab, _ = _padded(y.astype(int), bounds)
    both = on[:, 1:]
    total = max(on.sum(), 1)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.array([[(both & (lab[:, :-1] == a) & (lab[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    for t in range(1, steps + 1):
        emit, move = theta[:-4], theta[-4:].reshape(2, 2) * chain
        score = np.stack([np.zeros(on.shape), seq @ emit], -1)
        fore, back = np.zeros_like(score), np.zeros_like(score)
        fore[:, 0] = score[:, 0]
        for i in range(1, on.shape[1]):
            step = np.logaddexp(fore[:, i - 1, :1] + move[0], fore[:, i - 1, 1:] + move[1]) + score[:, i]
            fore[:, i] = np.where(on[:, i, None], step, fore[:, i - 1])
        for i in range(on.shape[1] - 2, -1, -1):
            ahead = score[:, i + 1] + back[:, i + 1]
            step = np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1])
            back[:, i] = np.where(on[:, i + 1, None], step, 0)
        z = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        p = np.exp(fore + back - z[:, None, None])[..., 1] * on
        grad = np.zeros_like(theta)
        grad[:-4] = np.einsum("sl,slf->f", (lab - p) * on, seq)
        if chain:
            pair = np.exp(fore[:, :-1, :, None] + move + (score + back)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
            grad[-4:] = (seen - pair.sum((0, 1))).ravel()
        grad = grad / total - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return LineCRF(theta[:-4].copy(), theta[-4:].reshape(2, 2) * chain)


def viterbi(model: LineCRF, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The best labels of all sequences; a tie goes to content. Sequences advance together, so that the loop is over positions."""
    labels = np.zeros(len(x), np.int8)
    n = np.diff(bounds)
    if not len(x):
        return labels
    score = x @ model.emit
    by_size = np.argsort(-n, kind="stable")
    by_size = by_size[n[by_size] > 0]
    start, n = bounds[:-1][by_size], n[by_size]
    best = np.stack([np.zeros(len(start)), score[start]], 1)
    came = np.zeros((len(x), 2), np.int8)
    last = best.copy()
    for i in range(1, int(n[0])):
        k = int(np.searchsorted(-n, -i, "left"))  # sequences longer than i
        way = best[:k, :, None] + model.move
        came[start[:k] + i] = way[:, 1] >= way[:, 0]
        best = way.max(1)
        best[:, 1] += score[start[:k] + i]
        last[:k] = best
    state = (last[:, 1] >= last[:, 0]).astype(np.int8)
    for i in range(int(n[0]) - 1, -1, -1):
        k = int(np.searchsorted(-n, -i, "left"))
        at = start[:k] + i
        labels[at] = state[:k]
        state[:k] = came[at, state[:k]]
    return labels
