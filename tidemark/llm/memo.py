"""Results per distinct string of a worker process, found for whole arrays of hashes at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Memo:
    """Maps 64-bit hashes to rows of numbers. Strings seen before are not worked on again.

    At most ``most`` strings are remembered; beyond that the memory starts anew, which costs time and changes nothing.
    """

    def __init__(self, work: Callable[[list[bytes]], list[list]], dtype: type, most: int = 1_000_000) -> None:
        self.work, self.dtype, self.most = work, dtype, most
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.rank = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.values = np.zeros(0, self.dtype)

    def look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number under which the row of each span is kept; see ``rows``. Valid until the next call."""
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > self.most:
            self._clear()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            found = self.work([raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            sizes = np.array([len(f) for f in found], np.int64)
            self.values = np.concatenate([self.values, np.array([x for f in found for x in f], self.dtype)])
            ranks = len(self.starts) - 1 + np.arange(len(new))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            hashes = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.rank = hashes[order], np.concatenate([self.rank, ranks])[order]
            at = np.searchsorted(self.hashes, distinct)
        return self.rank[at][back] if len(distinct) else np.zeros(0, np.int64)

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.starts[numbers + 1] - self.starts[numbers]

    def rows(self, numbers: np.ndarray) -> np.ndarray:
        """The values of all these rows, one after another."""
        sizes = self.sizes(numbers)
        before = np.concatenate([[0], np.cumsum(sizes)])
        return self.values[np.repeat(self.starts[numbers] - before[:-1], sizes) + np.arange(before[-1])]
