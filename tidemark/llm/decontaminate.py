"""Benchmark decontamination: spaced seeds find where a text may hold a benchmark item, an alignment decides."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.text import LOWER, mix, parts, span_hashes, utf8, word_places

_WORDS_ONLY = LOWER.copy()
_WORDS_ONLY[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


@dataclass(frozen=True)
class SeedRule:
    """``masks``: the word positions of a window that are hashed (1) or ignored (0), each mask of the same span.

    A hit's diagonal is a leak if some stretch of it has ``least`` equal words, or nine tenths of a shorter item, and
    ``share`` of its words equal; the longest one from an equal word to an equal word is told. Items of fewer words than
    a mask spans are found where all their words follow each other, from ``shortest`` words on; a shorter item is no
    passage, and is in none. ``block_bytes`` bounds the text of the items that are broadcast together.
    """

    masks: tuple[str, ...] = ("11010011", "11100101", "10111001", "10011101")
    least: int = 12
    share: float = 0.8
    shortest: int = 4
    block_bytes: int = 8 << 20

    @property
    def span(self) -> int:
        return len(self.masks[0])


def _words(batch_column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and where each row begins among them."""
    data, offsets = utf8(batch_column)
    data = _WORDS_ONLY[data]
    starts, ends, rows = word_places(data, offsets)
    return span_hashes(data, starts, ends), np.searchsorted(rows, np.arange(len(offsets)))


def _seeds(words: np.ndarray, begins: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask, the hashes of all windows inside a row and the places where they begin."""
    span = len(masks[0])
    inside = np.ones(len(words), bool)
    left = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(words))
    places = np.flatnonzero(inside & (left >= span))
    for number, mask in enumerate(masks):
        h = np.full(len(places), number + 1, np.uint64)
        for j, used in enumerate(mask):
            if used == "1":
                h = (h ^ words[places + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        yield mix(h), places


def _runs(words: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words inside a row, and the places where they begin."""
    left = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(words))
    places = np.flatnonzero(left >= length)
    h = np.full(len(places), length, np.uint64)
    for j in range(length):
        h = mix(h ^ words[places + j])
    return h, places


@dataclass
class SeedIndex:
    """The items of a block: their words, all seeds in the order of their hashes, and for each length below the masks'
    span the whole items of that length, by hash."""

    ids: list
    words: np.ndarray
    begins: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    bits: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list, texts: list[str | None], masks: tuple[str, ...], shortest: int = 4) -> SeedIndex:
        words, begins = _words(pa.array(texts, pa.large_string()))
        found = list(_seeds(words, begins, masks))
        short = {}
        for length in range(shortest, len(masks[0])):
            which = np.flatnonzero(np.diff(begins) == length)
            if len(which):
                h, places = _runs(words, begins, length)
                h = h[np.searchsorted(places, begins[which])]
                short[length] = (np.sort(h), which[np.argsort(h, kind="stable")])
        hashes = np.concatenate([h for h, _ in found])
        places = np.concatenate([p for _, p in found])
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << 22, bool)
        bits[(hashes >> np.uint64(42)).astype(np.int64)] = True
        return SeedIndex(ids, words, begins, hashes[order], places[order], bits, short)


def _longest_stretch(equal: np.ndarray, least: int, share: float) -> tuple[int, int] | None:
    """The longest stretch from an equal word to an equal word that holds ``least`` of them and ``share`` of equal ones.

    Unequal words at its ends only lower a stretch's share, so there is one if any stretch of the diagonal will do.
    """
    at = np.flatnonzero(equal)
    if len(at) < max(1, least):
        return None
    # share as a fraction: from the i-th to the j-th equal word, up * (at[j] - at[i] + 1) <= down * (j - i + 1)
    up, down = Fraction(str(share)).limit_denominator(10**6).as_integer_ratio()
    excess = down * np.arange(len(at)) - up * at
    # the first i with excess[i] <= excess[j] + down - up is a new minimum
    first = np.searchsorted(-np.minimum.accumulate(excess), -(excess + down - up), "left")
    length = np.where(np.arange(len(at)) - first + 1 >= least, at - at[first] + 1, 0)
    j = int(np.argmax(length))
    return (int(at[first[j]]), int(at[j]) + 1) if length[j] else None


def find_leaks(column: pa.Array, index: SeedIndex, rule: SeedRule) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, words, equal words) of every leak; start and length in words of the row's text."""
    words, begins = _words(column)
    hits = []
    for h, places in _seeds(words, begins, rule.masks):
        maybe = np.flatnonzero(index.bits[(h >> np.uint64(42)).astype(np.int64)])
        first = np.searchsorted(index.hashes, h[maybe], "left")
        n = np.searchsorted(index.hashes, h[maybe], "right") - first
        which = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else first
        hits.append(np.stack([np.repeat(places[maybe], n), index.places[which.astype(np.int64)]], axis=1))
    place, item_place = np.concatenate(hits).T
    row = np.searchsorted(begins, place, "right") - 1
    item = np.searchsorted(index.begins, item_place, "right") - 1
    out = []
    # one look at each diagonal of a row and an item
    for r, i, d in np.unique(np.stack([row, item, place - item_place], axis=1), axis=0):
        a, b = index.begins[i], index.begins[i + 1]
        lo, hi = max(a, begins[r] - d), min(b, begins[r + 1] - d)
        equal = words[lo + d : hi + d] == index.words[lo:hi]
        stretch = _longest_stretch(equal, min(rule.least, -(-(b - a) * 9 // 10)), rule.share)
        if stretch:
            s, e = stretch
            out.append((int(r), int(i), int(lo + d + s - begins[r]), e - s, int(equal[s:e].sum())))
    for length, (known, which) in index.short.items():
        h, places = _runs(words, begins, length)
        first = np.searchsorted(known, h, "left")
        n = np.searchsorted(known, h, "right") - first
        for k in np.flatnonzero(n):
            r = int(np.searchsorted(begins, places[k], "right")) - 1
            out += [(r, int(i), int(places[k] - begins[r]), length, length) for i in which[first[k] : first[k] + n[k]]]
    return out


def _blocks(benchmark: DataFrame, rule: SeedRule, id_col: str, text_col: str) -> Iterator[tuple[bool, SeedIndex]]:
    """The items in blocks of about ``block_bytes``, one at a time, and whether a block is the last."""
    items = benchmark.select(benchmark[id_col].alias("id"), benchmark[text_col].alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = -(-size // rule.block_bytes)
    block = F.pmod(F.xxhash64("id", "body"), F.lit(max(1, n)))
    for k in range(n):
        rows = items.filter((block == k) & F.col("body").isNotNull()).collect()
        yield k + 1 == n, SeedIndex.of([r.id for r in rows], [r.body for r in rows], rule.masks, rule.shortest)


def _written(rows: DataFrame, shared: Broadcast) -> DataFrame:
    out = stored(rows)
    shared.destroy()
    return out


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rule: SeedRule = SeedRule(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per leak: ids of document and item, ``start_word``, ``n_words`` and ``n_equal`` of the stretch.

    Words are letters and digits in lower case (A-Z). Clean, null and empty texts give no row; neither do null items.
    An item that occurs at several places gives a row for each; repeated rows repeat theirs. Texts are read whole.
    The texts are read once for each block of items; a block's leaks are written before the next block is read.
    """
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))
    kind, item_kind = d.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, start_word long, n_words long, n_equal long"
    out = docs.sparkSession.createDataFrame([], schema)
    for last, index in _blocks(benchmark, rule, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def read(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, "body"):
                found = find_leaks(batch["body"], shared.value, rule)
                ids = batch["id"].take(pa.array([f[0] for f in found], pa.int64()))
                items = pa.array([shared.value.ids[f[1]] for f in found])
                rest = [pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)]
                if found:
                    yield pa.RecordBatch.from_arrays([ids, items, *rest], names=["id", "item", "start_word", "n_words", "n_equal"])

        found = d.mapInArrow(read, schema)
        out = out.union(found if last else _written(found, shared))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    rule: SeedRule = SeedRule(),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows without a leak, with all their columns; no row is moved between executors.

    What the items of one block leave is written before the next block is read. Null and empty texts stay, repeated rows
    stay or go together, and an empty benchmark leaves all.
    """
    for last, index in _blocks(benchmark, rule, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in find_leaks(batch[text_col], shared.value, rule)]] = False
                yield batch.filter(pa.array(keep))

        left = docs.mapInArrow(clean, docs.schema)
        docs = left if last else _written(left, shared)
    return docs
