"""The place in a text that is most like a surface, found through shared pairs of characters.

A window of the text is compared with the surface by the ratio of matching blocks
(``difflib``, fixed by the semantics). A ratio that is enough needs so many matching
characters that a number of pairs of neighbours must be shared: m characters match in at most
1 + (n - m) + (w - m) blocks, each of which holds one pair less than characters. The
text is indexed once by its pairs; a surface's pairs vote for the windows that they lie in,
and only windows with enough votes, and enough characters of the surface, are
compared. No window that could be enough is left out.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from math import ceil

import numpy as np

#: Windows of these shares of the surface's length are looked at, and the search ends at a start with such a ratio (fixed values of the semantics).
SHARES, ENOUGH = (0.7, 1.0, 1.3), 0.98


class TextIndex:
    """Where each character and each pair of neighbours stands in a text."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self._chars, self._pairs = self._sorted(codes), self._sorted(codes[:-1] << 21 | codes[1:])

    @staticmethod
    def _sorted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(codes, kind="stable")
        return codes[order], order

    @staticmethod
    def _places(held: tuple[np.ndarray, np.ndarray], code: int) -> np.ndarray:
        low, high = np.searchsorted(held[0], [code, code + 1])
        return held[1][low:high]

    def char(self, c: str) -> np.ndarray:
        return self._places(self._chars, ord(c))

    def pair(self, a: str, b: str) -> np.ndarray:
        return self._places(self._pairs, ord(a) << 21 | ord(b))

    def voted(self, surface: str, width: int, votes: int) -> np.ndarray:
        """Starts of the windows of a width, within the text, in which so many of the surface's pairs stand."""
        last = len(self.text) - width
        if last < 0:
            return np.empty(0, np.int64)
        if votes < 1:
            return np.arange(last + 1)
        places = [self.pair(a, b) for a, b in sorted(set(zip(surface, surface[1:], strict=False)))]
        hits = np.sort(np.concatenate([np.empty(0, np.int64), *places]))
        if len(hits) < votes:
            return np.empty(0, np.int64)
        low, high = np.maximum(hits[votes - 1 :] - width + 2, 0), np.minimum(hits[: len(hits) - votes + 1], last)
        fits = low <= high
        step = np.zeros(last + 2, np.int64)
        np.add.at(step, low[fits], 1)
        np.add.at(step, high[fits] + 1, -1)
        return np.flatnonzero(np.cumsum(step[:-1]) > 0)

    def candidates(self, surface: str, width: int, least: float) -> np.ndarray:
        """Starts of the windows of a width that may be like enough."""
        total = len(surface) + width
        need = ceil(least * total / 2)
        need += 2 * need / total < least  # what rounding lost
        need -= need > 0 and 2 * (need - 1) / total >= least
        if need > min(len(surface), width):
            return np.empty(0, np.int64)
        starts = self.voted(surface, width, 3 * need - total - 1)
        held = np.zeros(len(starts), np.int64)
        for c, n in Counter(surface).items():
            places = self.char(c)
            held += np.minimum(np.searchsorted(places, starts + width) - np.searchsorted(places, starts), n)
        return starts[held >= need]


def similar_window(index: TextIndex, surface: str, least: float = 0.8) -> tuple[int, int, float] | None:
    """Start, end and ratio of the window that is most like the surface, the first of equals; None if none is like enough.

    Windows are compared by start, then by width; once a start has one of ENOUGH, no later start is looked at.
    """
    text, n = index.text, len(surface)
    if not text or not surface:
        return None
    low = max(1, int(n * SHARES[0]))
    widths = (low, n, min(len(text), max(low, int(n * SHARES[2]))))
    found = {(int(s), k) for k, w in enumerate(widths) for s in index.candidates(surface, w, least)}
    # Windows that the text's end cuts short.
    found |= {(s, k) for k, w in enumerate(widths) for s in range(max(0, len(text) - w + 1), len(text))}
    best, before = None, -1
    for s, k in sorted(found):
        if s != before and best and best[2] >= ENOUGH:
            break
        before, e = s, min(len(text), s + widths[k])
        matcher = SequenceMatcher(None, surface, text[s:e], autojunk=False)
        bar = best[2] if best else least
        if matcher.real_quick_ratio() < bar or matcher.quick_ratio() < bar:
            continue
        ratio = matcher.ratio()
        if ratio >= least and (best is None or ratio > best[2]):
            best = (s, e, ratio)
    return best
