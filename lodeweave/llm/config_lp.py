"""The configuration linear program of bin packing over a length histogram, on the driver.

Everything here is of the size of the histogram, at most one entry per token length, whatever the
number of pieces.
"""

from __future__ import annotations

import numpy as np

ROUNDS, STEP, RATE = 12, 0.1, 0.24
#: The program is solved again for what its rounding leaves, until that places less than this share of all pieces.
LEAST = 0.02


def best_fill(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each capacity the dearest filling's price and its last item, -1 for none, -2 where one token stays free."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    worth, item = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, dtype=np.int64)
    worth[lengths], item[lengths] = prices, np.arange(len(lengths))
    turned = np.zeros(capacity + 1)  # best from the end, so that both operands of a sum run forward
    for c in range(1, capacity + 1):
        value = worth[1 : c + 1] + turned[capacity + 1 - c :]
        i = int(value.argmax())
        best[c], last[c] = best[c - 1], -2
        if value[i] > best[c]:
            best[c], last[c] = value[i], item[i + 1]
        turned[capacity - c] = best[c]
    return best, last


def columns(lengths: np.ndarray, last: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length the dearest configuration that holds it, followed until nothing more fits: length, item and how often, sorted."""
    own, n = np.arange(len(lengths)), len(lengths)
    used = [own * n + own]
    full = np.maximum.accumulate(np.where(last != -2, np.arange(capacity + 1), 0))
    free = full[capacity - lengths]
    while len(own := own[keep := last[free] >= 0]):
        free = free[keep]
        item = last[free]
        used.append(own * n + item)
        free = full[free - lengths[item]]
    cell, times = np.unique(np.concatenate(used), return_counts=True)
    return cell // n, cell % n, times


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A fractional solution of the covering program: multiplicities of configurations, where each one's items begin (and the last ends), the items and how often each.

    Multiplicative weights: each round prices configurations by the knapsack program under the present
    duals; every length's best configuration grows by a step that covers no length by more than STEP of
    its count, and the duals of what was covered fall exponentially. A configuration may come up again.
    """
    rng = np.random.default_rng(seed)
    duals, parts = lengths / capacity, []
    covered = np.zeros(len(lengths))
    for _ in range(ROUNDS):
        prices = duals * (1 + 0.02 * rng.random(len(lengths)))
        _, last = best_fill(lengths, prices, capacity)
        column, item, times = columns(lengths, last, capacity)
        load = np.bincount(item, weights=times * counts[column], minlength=len(lengths))
        share = np.full(len(lengths), np.inf)
        np.minimum.at(share, column, (counts / np.maximum(load, 1e-9))[item])
        grow = STEP * share * counts
        now = np.bincount(item, weights=times * grow[column], minlength=len(lengths)) / counts
        covered += now
        parts.append((grow, np.bincount(column, minlength=len(lengths)), item, times))
        duals *= np.exp(-RATE * (now / STEP - (now / STEP).mean()))
        duals = np.clip(duals, 0.25 * lengths / capacity, 4 * lengths / capacity)
    value, size, item, times = (np.concatenate(p) for p in zip(*parts))
    scale = (counts * lengths).sum() / max(1e-9, (covered * counts * lengths).sum())
    return value * scale, np.concatenate([[0], np.cumsum(size)]), item, times


def rounded(x: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], lengths: np.ndarray, counts: np.ndarray, seed: int = 2) -> tuple[list[tuple[int, dict[int, int]]], np.ndarray]:
    """Whole multiplicities that overfill no count, and what stays uncovered.

    Systematic rounding: along the configurations one is taken whenever the running sum of multiplicities
    passes the next whole number plus a random start, so that as many are taken as the solution has, and
    each as often as its multiplicity says, to within one. A taken configuration for which too few pieces
    are left stays away; the program is solved again for what is uncovered.
    """
    value, at, item, times = x
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(value))
    taken = np.diff(np.floor(np.cumsum(value[order]) + rng.random()).astype(np.int64), prepend=0)
    left, out = counts.astype(np.int64).copy(), []
    for i, n in zip(order[taken > 0].tolist(), taken[taken > 0].tolist()):
        own, often = item[at[i] : at[i + 1]], times[at[i] : at[i + 1]]
        if (n := min(n, int((left[own] // often).min()))) > 0:
            left[own] -= n * often
            out.append((n, dict(zip(lengths[own].tolist(), often.tolist()))))
    return out, left


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int, begun: list[tuple[int, dict[int, int]]]) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing by counts of what the rounding left, into the sequences begun and new ones: (number of sequences, their items)."""
    open_: dict[int, list[list]] = {}  # free tokens -> [number of sequences, items]
    spaces = np.zeros(capacity + 1, dtype=bool)
    for number, items in begun:
        free = capacity - sum(length * n for length, n in items.items())
        open_.setdefault(free, []).append([number, items])
        spaces[free] = free > 0
    for length, n in sorted(((int(a), int(b)) for a, b in zip(lengths, counts) if b), reverse=True):
        while n:
            at = length + int(np.argmax(spaces[length:])) if spaces[length:].any() else -1
            if at >= 0:
                groups = open_[at]
                number, items = groups.pop()
                per = min(at // length, max(1, n // number)) if number <= n else 1
                take = min(number, n // per)
                if number > take:
                    groups.append([number - take, items])
                if not groups:
                    del open_[at]
                    spaces[at] = False
                new, free = dict(items), at - per * length
                new[length] = new.get(length, 0) + per
                n -= take * per
                open_.setdefault(free, []).append([take, new])
                spaces[free] = free > 0
            else:
                per = min(capacity // length, n)
                take = n // per
                n -= take * per
                free = capacity - per * length
                open_.setdefault(free, []).append([take, {length: per}])
                spaces[free] = free > 0
    return [(k, items) for groups in open_.values() for k, items in groups]


def plan(lengths, counts, capacity: int, told: dict | None = None) -> list[tuple[int, dict[int, int]]]:
    """Sequences that hold every piece once: (number of such sequences, {length: pieces of it}).

    told gets "program", the share of pieces shorter than capacity that stand in a configuration of the
    program; best fit places the others, first into those configurations' free room.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    out = [(int(n), {capacity: 1}) for n in counts[lengths == capacity]]
    counts, lengths = counts[lengths < capacity], lengths[lengths < capacity]
    if not len(lengths):
        return out
    left, whole, seed = counts.copy(), [], 1
    while (open_ := left > 0).any():
        got, rest = rounded(solve(lengths[open_], left[open_].astype(float), capacity, seed), lengths[open_], left[open_], seed)
        placed = left[open_].sum() - rest.sum()
        left[open_] = rest
        whole += got
        seed += 1
        if placed < LEAST * counts.sum():
            break
    if told is not None:
        told["program"] = 1 - left.sum() / counts.sum()
    return out + best_fit(lengths, left, capacity, whole)
