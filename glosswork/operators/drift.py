"""Places of a changed copy of a text in the text itself.

Shingles that stand once in either are anchors; where there are none, the longest common stretch is one. Their places in the copy, in
order, and in the text form a longest increasing run: a chain that no anchor
crosses. Anchors are widened to stretches that are equal, character by character; between two
stretches places are spread evenly. A chain costs as much as sorting its anchors, however
much has changed.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

SHINGLE = 12


def _single(text: str, size: int) -> dict[str, int]:
    """Shingles that stand once, and where."""
    found: dict[str, int] = {}
    for i in range(len(text) - size + 1):
        part = text[i : i + size]
        found[part] = -1 if part in found else i
    return {k: v for k, v in found.items() if v >= 0}


def increasing(values: list[int]) -> list[int]:
    """Numbers of the elements of a longest increasing run."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[at], ends[at] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _chained(copy: str, text: str, size: int) -> list[tuple[int, int, int]]:
    """Stretches along the chain of shingles that stand once in either."""
    mine, theirs = _single(copy, size), _single(text, size)
    pairs = sorted((i, theirs[part]) for part, i in mine.items() if part in theirs)
    chain = [pairs[k] for k in increasing([j for _, j in pairs])]
    out: list[tuple[int, int, int]] = []
    for i, j in chain:
        low_i, low_j = (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) if out else (0, 0)
        if i + size <= low_i and j + size <= low_j:
            continue  # within the last stretch
        if i < low_i or j < low_j:
            if i - low_i != j - low_j:  # on another diagonal: what is left of the anchor
                cut = max(low_i - i, low_j - j)
                if cut >= size:
                    continue
                i, j = i + cut, j + cut
            else:
                i, j = low_i, low_j
        while i > low_i and j > low_j and copy[i - 1] == text[j - 1]:
            i, j = i - 1, j - 1
        n = 0
        while i + n < len(copy) and j + n < len(text) and copy[i + n] == text[j + n]:
            n += 1
        if n:
            out.append((i, j, n))
    return out


def longest_common(copy: str, text: str, least: int) -> tuple[int, int, int] | None:
    """The longest stretch, of so many characters at least, that stands in both: the first in the copy, then in the text. Lengths are tried by halves, with hashes of all windows of a length."""
    for one, other in ((text, copy), (copy, text)):
        if len(one) >= least and (at := other.find(one)) >= 0:
            return (at, 0, len(one)) if one is text else (0, at, len(one))
    sides = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) for x in (copy, text)]
    n = max(map(len, sides))
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, 0x9E3779B97F4A7C15, np.uint64)]))
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((x + np.uint64(1)) * powers[: len(x)])]) for x in sides]

    def common(length: int) -> tuple[int, int, int] | None:
        a, b = ((x[length:] - x[:-length]) * powers[n - np.arange(len(x) - length)] for x in sums)
        places = np.flatnonzero(np.isin(a, b))
        if not len(places):
            return None
        i, j = int(places[0]), int(np.flatnonzero(b == a[places[0]])[0])
        return (i, j, length) if copy[i : i + length] == text[j : j + length] else None

    best, low, high = None, least, min(map(len, sides))
    while low <= high:
        middle = (low + high) // 2
        found = common(middle)
        best, low, high = (found, middle + 1, high) if found else (best, low, middle - 1)
    return best


def equal_stretches(copy: str, text: str, size: int = SHINGLE) -> list[tuple[int, int, int]]:
    """(place in the copy, place in the text, length) of stretches that are equal, in order and apart in both.

    What lies between two stretches is looked at by itself. Where no shingle stands once, as in a
    text that repeats itself, the longest common stretch is taken.
    """
    out: list[tuple[int, int, int]] = []
    gaps = [(0, len(copy), 0, len(text))]
    while gaps:
        i0, i1, j0, j1 = gaps.pop()
        if min(i1 - i0, j1 - j0) < size:
            continue
        mine, theirs = copy[i0:i1], text[j0:j1]
        found = _chained(mine, theirs, size) or [x for x in [longest_common(mine, theirs, size)] if x]
        found = [(i0 + i, j0 + j, n) for i, j, n in found]
        out += found
        ends = [(i0, j0, 0), *found, (i1, j1, 0)]
        if found:
            gaps += [(i + n, i2, j + n, j2) for (i, j, n), (i2, j2, _) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def boundaries(copy: str, text: str, size: int = SHINGLE) -> np.ndarray:
    """For each boundary of the copy, from 0 to its length, one of the text; they never go back."""
    stretches = equal_stretches(copy, text, size)
    known = [(0, 0)] if not stretches or stretches[0][:2] != (0, 0) else []
    for i, j, n in stretches:
        known += [(i, j), (i + n, j + n)]
    known.append((len(copy), len(text)))
    places, values = (np.array(x, np.int64) for x in zip(*known, strict=True))
    return np.rint(np.interp(np.arange(len(copy) + 1), places, values)).astype(np.int64)
