"""Hashes of words and of runs of words, many at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class WordHashes(dict):
    """word -> 64-bit hash; forgets all words when it holds too many."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words, given the words' hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        if size <= 8:
            for k in range(size):
                out = out * np.uint64(_P) + hashes[k : n + k]
            return mix(out)
        up, down = _tables(len(hashes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
        return mix((sums[size:] - sums[:-size]) * down[:n])


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse, modulo 2**64."""
    held = _powers.get(0)
    if held is None or len(held[0]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_P, -1, 1 << 64)
        with np.errstate(over="ignore"):
            held = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, p & _MASK, np.uint64)]), dtype=np.uint64) for p in (_P, inverse))
        _powers[0] = held
    return held


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of width values."""
    if len(values) < width:
        return values[:0]
    out, held = values, 1
    while 2 * held <= width:
        out, held = pick(out[: len(out) - held], out[held:]), 2 * held
    rest = width - held
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def rolled_prefix(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each run hashes[start:stop], whatever its place and length."""
    up, down = _tables(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
        return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
