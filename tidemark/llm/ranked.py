"""Ranked lexical search: best-first document intervals, bounded by range maxima of posting lists.

Documents are read in blocks. A block keeps, for every term of the items, its postings in the block's document order and
a sparse table of their range maxima. A search begins with the whole block as one interval; the sum of its terms' maxima
bounds every score in it. The intervals of the greatest bounds are split at the document that holds their greatest
impact: that document is scored, and what lies left and right of it is bounded anew. An interval whose bound is below the
tenth best score so far is done. Scores, bounds and ties are exact; no interval is given up otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import stored
from tidemark.llm.text import LOWER, parts, span_hashes, utf8, word_places

# Bytes outside of terms are read as spaces; A-Z are lower-cased.
_TERMS_ONLY = LOWER.copy()
_TERMS_ONLY[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


@dataclass(frozen=True)
class SearchRule:
    """``top`` documents per item. Items are broadcast in blocks of ``item_bytes`` of text; a block of documents ends
    with ``postings`` postings of their terms; ``wide`` intervals are split together at most."""

    top: int = 10
    item_bytes: int = 4 << 20
    postings: int = 1 << 19
    wide: int = 1024


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the row of each."""
    data, offsets = utf8(column)
    data = _TERMS_ONLY[data]
    starts, ends, rows = word_places(data, offsets)
    return span_hashes(data, starts, ends), rows


def _counted(group: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, term) in order, and how often each occurs."""
    pairs, n = np.unique(group * terms + term, return_counts=True)
    return pairs // max(terms, 1), pairs % max(terms, 1), n


@dataclass
class Items:
    """The items of a block: the hashes of their terms in order, and each item's terms as places among them."""

    vocabulary: np.ndarray
    begins: np.ndarray
    terms: np.ndarray

    @staticmethod
    def of(texts: list[str | None]) -> Items:
        h, rows = _terms(pa.array(texts, pa.large_string()))
        vocabulary, place = np.unique(h, return_inverse=True)
        owner, term, _ = _counted(rows, place, len(vocabulary))
        return Items(vocabulary, np.searchsorted(owner, np.arange(len(texts) + 1)), term)

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each row, and (row, term of the vocabulary, occurrences) in that order."""
        h, rows = _terms(column)
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(len(self.vocabulary) - 1, 0))
        hit = self.vocabulary[at] == h if len(self.vocabulary) else np.zeros(len(h), bool)
        return np.bincount(rows, minlength=len(column)), *_counted(rows[hit], at[hit], len(self.vocabulary))


class Postings:
    """The postings of a block by (term, document), and the places of their range maxima."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> None:
        order = np.lexsort((doc, term))
        self.docs, self.doc, self.impact = docs, doc[order], impact[order]
        self.key = term[order] * docs + self.doc
        longest = int(np.bincount(term).max()) if len(term) else 0
        # level j at i: the place of the greatest impact among the 2^j postings from i on
        self.levels = [np.arange(len(doc), dtype=np.int32)]
        for j in range(1, longest.bit_length()):
            low = self.levels[-1]
            half = 1 << (j - 1)
            other = np.concatenate([low[half:], low[len(low) - half :]]) if half <= len(low) else low
            self.levels.append(np.where(self.impact[other] > self.impact[low], other, low).astype(np.int32))
        self.levels = np.stack(self.levels)

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the greatest impact in [a, b) for ranges of one term each."""
        j = np.frexp((b - a).astype(float))[1] - 1
        left, right = self.levels[j, a], self.levels[j, b - (1 << j)]
        return np.where(self.impact[right] > self.impact[left], right, left)


def _bounded(index: Postings, owner: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For intervals with ranges (owner, a, b), in order of owner: owners, bounds and documents to split at."""
    place = index.greatest(a, b)
    impact = index.impact[place]
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    bound = np.add.reduceat(impact, begin)
    most = np.maximum.reduceat(impact, begin)
    size = np.diff(np.append(begin, len(owner)))
    first = np.flatnonzero(impact == np.repeat(most, size))
    which = first[np.searchsorted(first, begin)]
    return owner[begin], bound, index.doc[place[which]]


def search(index: Postings, terms: np.ndarray, top: int, floor: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block: its ``top`` best and all that equal the last of them, from ``floor`` on."""
    found_doc, found_score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a = np.searchsorted(index.key, terms * index.docs)
    b = np.searchsorted(index.key, (terms + 1) * index.docs)
    some = a < b
    if not some.any():
        return found_doc[0], found_score[0]
    # ranges of all open intervals, in their order
    a, b, term = a[some], b[some], terms[some]
    owner = np.zeros(len(a), np.int64)
    _, bound, split = _bounded(index, owner, a, b)
    best = np.zeros(0, np.int64)
    step = 4
    while len(bound):
        if len(bound) > step:
            chosen = np.zeros(len(bound), bool)
            chosen[np.argpartition(-bound, step)[:step]] = True
        else:
            chosen = np.ones(len(bound), bool)
        step = min(wide, step * 2)
        mine = chosen[owner]
        who, t, x, y = owner[mine], term[mine], a[mine], b[mine]
        d = split[who]
        p = np.searchsorted(index.key, t * index.docs + d)
        here = (p < y) & (index.doc[np.minimum(p, len(index.doc) - 1)] == d)
        number = np.cumsum(chosen) - 1
        score = np.bincount(number[who[here]], index.impact[p[here]], int(chosen.sum())).astype(np.int64)
        good = score >= floor
        found_doc.append(split[chosen][good])
        found_score.append(score[good])
        best = np.concatenate([best, score[good]])
        if len(best) > top:
            best = np.partition(best, len(best) - top)[len(best) - top :]
        if len(best) == top:
            floor = max(floor, int(best.min()))
        # what lies on either side of the split documents, behind the intervals that were not chosen
        rest = np.flatnonzero(~chosen & (bound >= floor))
        renumber = np.full(len(bound), -1)
        renumber[rest] = np.arange(len(rest))
        stay = renumber[owner] >= 0
        side = np.concatenate([2 * who, 2 * who + 1])
        child_a, child_b = np.concatenate([x, p + here]), np.concatenate([p, y])
        child_t = np.concatenate([t, t])
        some = child_a < child_b
        order = np.argsort(side[some], kind="stable")
        side, child_a, child_b, child_t = (v[some][order] for v in (side, child_a, child_b, child_t))
        if len(side):
            sides, child_bound, child_split = _bounded(index, side, child_a, child_b)
            open_ = child_bound >= floor
            place = np.cumsum(open_) - 1 + len(rest)
            at = np.searchsorted(sides, side)
            live = open_[at]
            owner = np.concatenate([renumber[owner[stay]], place[at[live]]])
            a, b = np.concatenate([a[stay], child_a[live]]), np.concatenate([b[stay], child_b[live]])
            term = np.concatenate([term[stay], child_t[live]])
            bound = np.concatenate([bound[rest], child_bound[open_]])
            split = np.concatenate([split[rest], child_split[open_]])
        else:
            owner, a, b, term, bound, split = renumber[owner[stay]], a[stay], b[stay], term[stay], bound[rest], split[rest]
    docs, scores = np.concatenate(found_doc), np.concatenate(found_score)
    return docs[scores >= floor], scores[scores >= floor]


class _Best:
    """The best documents of each item so far, over the blocks of a task."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.rows, self.floor = top, [[] for _ in range(items)], [1] * items

    def add(self, item: int, scores: list[int], ids: list) -> None:
        """Of equal scores the smaller id is better, and none is the last."""
        rows = self.rows[item] + list(zip(scores, ids))
        rows.sort(key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))
        self.rows[item] = rows[: self.top]
        if len(rows) >= self.top:
            self.floor[item] = rows[self.top - 1][0]


def _search_block(
    ids: pa.Array, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray,
    items: Items, weight: np.ndarray, stats: tuple[int, int], best: _Best, rule: SearchRule,
) -> None:
    count, total = stats
    m = 10 + (90 * n * count) // total
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    index = Postings(place[owner], term, impact, len(order))
    for k in range(len(items.begins) - 1):
        terms = items.terms[items.begins[k] : items.begins[k + 1]]
        docs, scores = search(index, terms, rule.top, best.floor[k], rule.wide)
        if len(docs):
            first = np.lexsort((docs, -scores))[: rule.top]
            best.add(k, scores[first].tolist(), ids.take(pa.array(order[docs[first]])).to_pylist())


def _blocks(benchmark: DataFrame, rule: SearchRule, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items in blocks of about ``item_bytes``, one at a time."""
    rows = benchmark.select(benchmark[id_col].alias("id"), benchmark[text_col].alias("body")).filter("body is not null")
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = -(-size // rule.item_bytes)
    for k in range(n):
        found = rows.filter(F.pmod(F.xxhash64("id", "body"), F.lit(n)) == k).collect()
        yield [r.id for r in found], [r.body for r in found]


def _indexed(docs: DataFrame, items, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) of the documents with a term; ``terms`` are those of the vocabulary, in order."""
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "body"):
            n, row, term, tf = items.value.find(batch["body"])
            starts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(v, pa.int32())) for v in (term, tf)]
            out = pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(read, f"id {kind}, n long, terms array<int>, tfs array<int>")


def _found(index: DataFrame, items, weight, stats: tuple[int, int], rule: SearchRule) -> DataFrame:
    """(item, id, score): the best documents of each task for every item; ``item`` is its number in the block."""
    kind = index.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(index.schema["id"].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(items.value.begins) - 1, rule.top)
        held, size = [], 0

        def flush() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = [rows[c].combine_chunks() for c in ("terms", "tfs")]
            n = pc.list_value_length(lists[0]).to_numpy()
            term, tf = (v.flatten().to_numpy().astype(np.int64) for v in lists)
            own = np.repeat(np.arange(len(n)), n)
            ids = rows["id"].combine_chunks()
            _search_block(ids, rows["n"].to_numpy(), own, term, tf, items.value, weight.value, stats, best, rule)

        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch["terms"]).to_numpy().astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + rule.postings - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - done)
                at = to
                if size >= rule.postings or at < batch.num_rows:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        rows = [(k, id_, score) for k, found in enumerate(best.rows) for score, id_ in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], id_type),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            names=["item", "id", "score"],
        )

    return index.mapInArrow(read, f"item long, id {kind}, score long")


def search_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    rule: SearchRule = SearchRule(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item, ``rank``, document, ``score``): the ``top`` best documents of every row of ``benchmark``, scores above 0.

    A score adds w * (10^9 tf div (1000 tf + 8 m)) over the item's terms, once each, with w = floor(1000 ln((2N + 2) /
    (2 df + 1))) and m = 10 + (90 n N) div L. Of equal scores the smaller id comes first, none last. Every row of
    ``docs`` is a document: repeated rows are ranked each, and every row of ``benchmark`` has ranks of its own. Null and
    wordless texts are in no result and in no count. Texts are read whole and must fit a task; other columns are not read.
    Items are read in blocks, with one pass over the documents for each; the terms of a block are of bounded size.
    """
    spark = docs.sparkSession
    names = [docs.select(docs[id_col]).schema[0].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    out = spark.createDataFrame([], f"item {names[1]}, rank int, id {names[0]}, score long")
    for ids, texts in _blocks(benchmark, rule, item_col, item_text_col):
        items = Items.of(texts)
        shared = spark.sparkContext.broadcast(items)
        index = stored(_indexed(docs, shared, id_col, text_col))
        count, total = index.agg(F.count("*"), F.sum("n")).first()
        if not count:
            continue
        df = np.zeros(len(items.vocabulary), np.int64)
        for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r.term] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found = _found(index, shared, spark.sparkContext.broadcast(weight), (count, total), rule)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rule.top)
        numbers = spark.createDataFrame(list(enumerate(ids)), f"item long, name {names[1]}")
        ranked = ranked.join(F.broadcast(numbers), "item").select(F.col("name").alias("item"), "rank", "id", "score")
        out = out.union(ranked)
    return out.withColumnsRenamed({"item": item_col, "id": id_col})
