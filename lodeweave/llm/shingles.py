"""Word shingle sets as 64-bit hashes, computed in numpy over Arrow's text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ROOT, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))
#: Bytes of text worked on at once (a longer text alone).
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ROOT)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of the root and its inverse, grown as texts ask for them."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _ROOT))])
                cls.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _INVERSE))])
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    with np.errstate(over="ignore"):
        up, down = Powers.of(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up)])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles, ascending, and where each text's begin.

    Fewer than k words give the whole sequence as one shingle, no words none.
    """
    words, at = word_hashes(data, offsets)
    n = len(at) - 1
    count = np.diff(at)
    with np.errstate(over="ignore"):
        made = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            made += words[i : len(words) - k + 1 + i] * (_ODD + np.uint64(2 * i)) if len(made) else made
        text = np.repeat(np.arange(n), count)
        whole = text[: len(made)] == text[k - 1 :] if len(made) else np.zeros(0, bool)
        made, owner = mix(made[whole]), text[: len(made)][whole]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            few = []
            for t in short:
                own = words[at[t] : at[t + 1]]
                few.append((own * (_ODD + np.uint64(2) * np.arange(len(own), dtype=np.uint64))).sum(dtype=np.uint64) + np.uint64(len(own)) * _ROOT)
            made, owner = np.concatenate([made, mix(np.array(few, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((made, owner))
    made, owner = made[order], owner[order]
    if len(made):
        new = np.concatenate([[True], (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])])
        made, owner = made[new], owner[new]
    return made, np.searchsorted(owner, np.arange(n + 1))


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about SLICE bytes: first row, one after the last, their UTF-8 bytes and offsets; null as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, side="right")) - 1)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
