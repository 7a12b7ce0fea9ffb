"""Where a byte-level tokenizer's pre-tokens begin, for whole arrays of text."""

from __future__ import annotations

import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
# Code points that count as white space, and the endings that an apostrophe is joined with.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SHORT = ("s", "t", "m", "d")
_LONG = ("re", "ve", "ll")

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point; unknown are those that Python's tables do not have and a tokenizer's may."""
    if not _classes:
        by = {"L": LETTER, "N": NUMBER} | {"Cn": UNKNOWN}
        names = (unicodedata.category(chr(c)) for c in range(0x110000))
        table = np.fromiter((by.get(n, by.get(n[0], OTHER)) for n in names), np.uint8, 0x110000)
        table[_SPACES] = SPACE
        _classes.append(table)
    return _classes[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    b = data[at].astype(np.uint32)
    size = 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)
    value = np.where(size == 1, b, b & (0x7F >> size))
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        value[more] = (value[more] << 6) | (data[at[more] + k] & 0x3F)
    return value, at


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte places at which pre-tokens begin: runs of letters, of numbers or of other characters, each with one space
    before it if there is one; what else there is of white space; an apostrophe with an English ending."""
    points, at = code_points(data)
    n = len(points)
    if not n:
        return at
    kind = classes()[points]
    row = np.zeros(n, bool)
    row[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
    begin = row.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # the last of some white space before a word is a token by itself, or belongs to the word if it is a space
    after = np.flatnonzero(begin & ~row & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    begin[after - 1] = True
    begin[after[points[after - 1] == 0x20]] = False
    # an apostrophe that begins a token and a word right behind it
    mark = np.flatnonzero(begin[:-1] & (points[:-1] == 0x27) & (kind[1:] == LETTER) & ~row[1:])
    if len(mark):
        second = np.minimum(mark + 2, n - 1)
        one = np.isin(points[mark + 1], [ord(c) for c in _SHORT])
        two = np.zeros(len(mark), bool)
        for a, b in _LONG:
            two |= (points[mark + 1] == ord(a)) & (points[second] == ord(b)) & (second > mark + 1) & ~row[second]
        for found, length in ((one, 1), (two, 2)):
            begin[mark[found] + 1] = False
            behind = mark[found] + 1 + length
            begin[behind[behind < n]] = True
    if (kind == UNKNOWN).any():
        # from white space to white space, what holds one is left in one piece, with the white space before it
        solid = kind != SPACE
        edge = row | np.concatenate([[True], solid[:-1] & ~solid[1:]])
        run = np.cumsum(edge) - 1
        begin &= edge | ~np.isin(run, run[kind == UNKNOWN])
    return at[begin]
