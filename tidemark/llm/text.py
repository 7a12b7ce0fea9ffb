"""Texts of Arrow batches as arrays: bytes, word places and word hashes, without an object per word."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together; a longer text is a part of its own.
PART = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 1 << 62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes, data = column.buffers()[1:]
    offsets = np.frombuffer(sizes, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], column: str, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the input moves about half of the output's."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    while len(_powers[0]) <= n:
        size = len(_powers[0])
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.uint64(pow(base, size, 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers[0], _powers[1]


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words end at white space and where a text ends."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Longer spans are hashed by a digest: sums of powers modulo 2^64 have known collisions from some hundred bytes on.
LONG_SPAN = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same for equal bytes anywhere."""
    power, inverse = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    out = mix(h + (ends - starts).astype(np.uint64) * _ODD[63])
    long = np.flatnonzero(ends - starts > LONG_SPAN)
    if len(long):
        digests = b"".join(blake2b(data[s:e].tobytes(), digest_size=8).digest() for s, e in zip(starts[long], ends[long]))
        out[long] = np.frombuffer(digests, np.uint64)
    return out


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of k words in a text; a shorter text with a word is one run."""
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    if not len(words):
        return words, rows
    h = np.zeros(len(words), np.uint64)
    left = ends[rows] - np.arange(len(words))
    for j in range(k):
        term = np.zeros(len(words), np.uint64)
        term[: max(len(words) - j, 0)] = words[j:] * _ODD[j]
        h += np.where(left > j, term, np.uint64(0))
    short = (counts[rows] < k) & (left == counts[rows])
    chosen = (left >= k) | short
    size = np.minimum(counts[rows], k).astype(np.uint64)
    return mix(h + size * _ODD[62])[chosen], rows[chosen]
