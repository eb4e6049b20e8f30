"""Linear-chain conditional random fields in numpy, for small models trained on the driver."""

from __future__ import annotations

import numpy as np

#: Chains, or tokens of one, whose feature weights stand in memory together.
AT_ONCE = 512


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(emit: np.ndarray, move: np.ndarray, start: np.ndarray, lengths: np.ndarray, end: np.ndarray | None = None):
    """Marginals [B, L, K], expected moves [K, K] and log Z [B] of padded chains; end scores the last state."""
    n, size, k = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = start + emit[:, 0]
    live = np.arange(size)[None, :] < lengths[:, None]
    for t in range(1, size):
        new = _lse(alpha[:, t - 1][:, :, None] + move[None], 1) + emit[:, t]
        alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
    last = alpha[:, -1] if end is None else alpha[:, -1] + end
    if end is not None:
        beta[:] = end
    z = _lse(last, 1)
    for t in range(size - 2, -1, -1):
        new = _lse(move[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(live[:, t + 1, None], new, beta[:, t])
    marginal = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
    moves = np.zeros((k, k))
    for t in range(1, size):
        pair = alpha[:, t - 1][:, :, None] + move[None] + (emit[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
        moves += np.exp(pair[live[:, t]]).sum(0)
    return marginal, moves, z


def viterbi(emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> list[int]:
    """The best state sequence of one chain [L, K]; ties to the lower state."""
    best, back = start + emit[0], []
    for row in emit[1:]:
        step = best[:, None] + move
        back.append(step.argmax(0))
        best = step.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


class Crf:
    """Feature weights [F, K], transitions and start scores; feature 0 is padding."""

    def __init__(self, features: int, states: int):
        self.weight, self.move, self.start = np.zeros((features, states)), np.zeros((states, states)), np.zeros(states)

    def emit(self, ids: np.ndarray) -> np.ndarray:
        """Scores [..., K] of feature ids [..., F]; AT_ONCE rows' weights are gathered together."""
        out = np.empty((*ids.shape[:-1], self.weight.shape[1]))
        for i in range(0, len(ids), AT_ONCE):
            self.weight[ids[i : i + AT_ONCE]].sum(axis=-2, out=out[i : i + AT_ONCE])
        return out

    def fit(self, ids: np.ndarray, truth: np.ndarray, lengths: np.ndarray, rounds: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> "Crf":
        """Maximum likelihood by Adam over all chains at once. ids [B, L, F], truth [B, L]."""
        n, size, width = ids.shape
        states = self.weight.shape[1]
        live = np.arange(size)[None, :] < lengths[:, None]
        gold = np.eye(states)[truth] * live[:, :, None]
        moved = np.zeros((states, states))
        both = live[:, 1:]
        np.add.at(moved, (truth[:, :-1][both], truth[:, 1:][both]), 1)
        first = gold[:, 0].sum(0)
        params = [self.weight, self.move, self.start]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        flat = ids.reshape(-1)
        for t in range(1, rounds + 1):
            marginal, moves, _ = forward_backward(self.emit(ids), self.move, self.start, lengths)
            gap = (marginal - gold).reshape(-1, states)
            dw = np.stack([np.bincount(flat, weights=np.repeat(gap[:, k], width), minlength=len(self.weight)) for k in range(states)], axis=1)
            dw[0] = 0
            grads = [dw / n + ridge * self.weight, (moves - moved) / n + ridge * self.move, (marginal[:, 0].sum(0) - first) / n]
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        self.weight[0] = 0
        return self


def padded(rows: list[list[list[int]]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains of feature lists as ids [B, L, width] and lengths."""
    lengths = np.array([len(r) for r in rows])
    ids = np.zeros((len(rows), int(lengths.max()), width), dtype=np.int64)
    for i, row in enumerate(rows):
        for j, own in enumerate(row):
            ids[i, j, : len(own)] = own
    return ids, lengths
