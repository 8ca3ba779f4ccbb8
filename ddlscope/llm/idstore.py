"""Lists of token ids by the 64-bit hash of a unit of text, in flat arrays."""

from __future__ import annotations

import numpy as np


def room(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with place for ``n`` values at least."""
    if n <= len(a):
        return a
    return np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class IdStore:
    def __init__(self):
        self.clear()

    def __len__(self) -> int:
        return len(self.known)

    def clear(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, their unit
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the sorted ``hashes`` aren't known."""
        if not len(self.known):
            return np.ones(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return self.known[at] != hashes

    def learn(self, hashes: np.ndarray, lists: list[list[int]]) -> int:
        """Adds units that aren't known, by ascending hash; the number of the first."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        first, n, total = len(self.known), len(lists), int(sizes.sum())
        self.ids = room(self.ids, self.used + total)
        self.ids[self.used:self.used + total] = np.fromiter((x for ids in lists for x in ids), np.uint32, total)
        self.start, self.size = room(self.start, first + n), room(self.size, first + n)
        self.start[first:first + n] = self.used + np.cumsum(sizes) - sizes
        self.size[first:first + n] = sizes
        self.used += total
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.number = np.insert(self.number, at, np.arange(first, first + n))
        return first

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The units of known hashes."""
        return self.number[np.searchsorted(self.known, hashes)]

    def joined(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units in turn, where each unit's ids end)."""
        size = self.size[number]
        end = np.cumsum(size)
        return self.ids[np.repeat(self.start[number] - end + size, size) + np.arange(end[-1] if len(end) else 0)], end
