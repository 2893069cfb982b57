"""All words of many texts at once, in numpy: where they stand and what they hash to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tidewater.llm.blocks import mix

PIECE = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words:
    """Hashes of all words of a run of bytes at once: sums of a random number for each byte, times powers of an odd number."""

    def __init__(self, fold: bool = True) -> None:
        """fold: A-Z count as a-z."""
        of = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
        self.of = of[np.frombuffer(LOWER, np.uint8)] if fold else of
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.base = 0x9E3779B97F4A7C15
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        for name, x in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
            p = getattr(self, name)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(x, len(p), 1 << 64))])
            setattr(self, name, p)

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the words of the texts data[off[i] : off[i + 1]]; no word crosses an offset."""
        start, _, h = self.spans(data, off)
        return start, h

    def spans(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, ends, hashes)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        blank = self.blank[data]
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        at = off[:-1][off[:-1] < n]
        first[at] = ~blank[at]
        at = off[1:][off[1:] > 0] - 1
        last[at] = ~blank[at]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        h, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, side="right")))
            lo, hi = int(start[i]), int(end[j - 1])
            self._powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.of[data[lo:hi]] * self.up[: hi - lo], out=total[1:])
            h[i:j] = (total[end[i:j] - lo] - total[start[i:j] - lo]) * self.down[start[i:j] - lo]
            i = j
        return start, end, mix(h)


def pieces(off: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes, at least one text each."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j
        i = j
