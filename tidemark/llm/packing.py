"""Packing token sequences as a cutting-stock problem: column generation over the histogram of piece lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.memo import Memo
from tidemark.llm.pretokens import pretoken_starts
from tidemark.llm.text import parts, span_hashes, utf8


@dataclass(frozen=True)
class PackRule:
    """Sequences of ``capacity`` tokens; lengths are rounded up to whole ``step`` for the histogram, which so has
    capacity / step classes however many documents there are. ``end`` closes each document."""

    capacity: int = 2048
    step: int = 16
    end: int = 1
    buckets: int = 64


def price(duals: np.ndarray, slots: int) -> tuple[float, np.ndarray]:
    """The pattern of largest value: class k (from 1) takes k slots and is worth duals[k - 1]. A knapsack by slots."""
    best, took = np.zeros(slots + 1), np.zeros(slots + 1, np.int64)
    for c in range(1, slots + 1):
        value = duals[:c] + best[c - 1 :: -1][:c]
        k = int(np.argmax(value))
        best[c], took[c] = (value[k], k + 1) if value[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern = np.zeros(len(duals))
    c = slots
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
        c -= took[c] or 1
    return best[slots], pattern


def generate_columns(demand: np.ndarray, rounds: int = 20_000) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each class) and how often each is used; together they hold exactly the demand.

    The linear program is solved over the patterns found so far, and the knapsack adds one while that pays. What is
    left after rounding down is filled by decreasing length.
    """
    slots = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    size = used + 1
    want = demand[used].astype(float)
    columns = np.diag(slots // size).astype(float)
    inverse = np.diag(1.0 / (slots // size))
    amount = inverse @ want
    duals = np.full(slots, -1.0)
    for _ in range(rounds):
        duals[used] = inverse.sum(axis=0)
        value, pattern = price(duals, slots)
        if value <= 1 + 1e-7:
            break
        enter = pattern[used]
        step = inverse @ enter
        ratio = np.full(len(step), np.inf)
        ratio[step > 1e-9] = amount[step > 1e-9] / step[step > 1e-9]
        out = int(np.argmin(ratio))
        amount -= ratio[out] * step
        amount[out] = ratio[out]
        np.maximum(amount, 0, out=amount)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = enter
    times = np.floor(amount + 1e-6).astype(np.int64)
    left = demand[used] - (columns @ times).astype(np.int64)
    while (left < 0).any():  # a rounding error of the amounts
        times[int(np.argmax(columns[int(np.argmin(left))] * (times > 0)))] -= 1
        left = demand[used] - (columns @ times).astype(np.int64)
    out_patterns: dict[tuple, int] = {}
    for j in np.flatnonzero(times):
        key = tuple(columns[:, j].astype(int))
        out_patterns[key] = out_patterns.get(key, 0) + int(times[j])
    while left.any():
        room, pattern = slots, np.zeros(len(used), np.int64)
        for k in range(len(used) - 1, -1, -1):
            n = min(int(left[k]), room // int(size[k]))
            pattern[k], room = n, room - n * int(size[k])
        often = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out_patterns[tuple(pattern)] = out_patterns.get(tuple(pattern), 0) + often
        left = left - often * pattern
    result = []
    for key, often in sorted(out_patterns.items()):
        whole = np.zeros(slots, np.int64)
        whole[used] = key
        result.append((whole, often))
    return result


_memos: dict[tuple[str, bool], Memo] = {}
_added: dict[str, re.Pattern | None] = {}


def _memo(path: str, added: bool) -> Memo:
    if (path, added) not in _memos:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added

        def work(words: list[bytes]) -> list[list[int]]:
            texts = [w.decode() for w in words]
            return [
                e.ids
                for i in range(0, len(texts), 5_000)
                for e in tokenizer.encode_batch_fast(texts[i : i + 5_000], add_special_tokens=False)
            ]

        _memos[path, added] = Memo(work, np.uint32)
    return _memos[path, added]


def _added_places(data: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Start and end of every added token of the file in the texts, the longest one where several begin."""
    if path not in _added:
        from tokenizers import Tokenizer

        tokens = Tokenizer.from_file(path).get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in tokens):
            raise ValueError("added tokens that look at their neighbours are not supported")
        names = sorted((t.content.encode() for t in tokens), key=lambda n: (-len(n), n))
        _added[path] = re.compile(b"|".join(map(re.escape, names))) if names else None
    pattern, raw = _added[path], data.tobytes()
    if pattern is None or not pattern.search(raw):
        return np.zeros((0, 2), np.int64)
    rows = zip(offsets[:-1].tolist(), offsets[1:].tolist())
    return np.array([m.span() for a, b in rows for m in pattern.finditer(raw, a, b)], np.int64).reshape(-1, 2)


def token_ids(column: pa.Array, path: str, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and where each text's begin; a byte-level tokenizer works on each pre-token by itself.

    With ``added``, the file's added tokens in a text have their own ids, as in the tokenizer's default; without, they
    are text as any other.
    """
    memo = _memo(path, added)
    data, offsets = utf8(column)
    spans = _added_places(data, offsets, path) if added else np.zeros((0, 2), np.int64)
    if len(spans):
        starts = pretoken_starts(data, np.union1d(offsets, spans))
        at = np.searchsorted(spans[:, 0], starts, "left") - 1
        starts = starts[(at < 0) | (starts >= spans[at, 1])]
    else:
        starts = pretoken_starts(data, offsets)
    ends = np.concatenate([starts[1:], offsets[-1:]])
    numbers = memo.look(data, starts, ends, span_hashes(data, starts, ends))
    total = np.concatenate([[0], np.cumsum(memo.sizes(numbers))])
    return memo.rows(numbers), total[np.searchsorted(starts, offsets)]


def pieces(docs: DataFrame, tokenizer: str, rule: PackRule, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): every document cut into full sequences and what is left."""
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("body"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "body"):
            ids, begins = token_ids(batch["body"], tokenizer, added=True)
            rows, cuts = [], []
            for r in range(batch.num_rows):
                own = np.append(ids[begins[r] : begins[r + 1]], rule.end).astype("<u4")
                for s in range(0, len(own), rule.capacity):
                    piece = own[s : s + rule.capacity]
                    rows.append(r)
                    cuts.append((s, len(piece), zlib.crc32(piece.tobytes()), len(own)))
            columns = [pa.array(c, pa.int64()) for c in zip(*cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(rows, pa.int64())), *columns],
                names=["id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(read, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(
    docs: DataFrame,
    tokenizer: str,
    rule: PackRule = PackRule(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text (null is empty) and the closing id, so an empty one has one token. It is cut into
    full sequences and a rest; the rests are placed by patterns. Pieces are ranked inside their length class, ties by
    id, place and content; pieces alike in all of these are interchangeable. Repeated rows are packed each. The rank
    within a class adds up over buckets, so that a class that holds most pieces is not sorted by one task. Only counts
    per class and bucket reach the driver. Other columns are not read; an empty table gives no sequences.
    """
    spark = docs.sparkSession
    slots = rule.capacity // rule.step
    cuts = pieces(docs, tokenizer, rule, id_col, text_col)
    cuts = cut(
        cuts.withColumn("class", F.expr(f"cast((length + {rule.step - 1}) div {rule.step} as int)")).withColumn(
            "bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(rule.buckets)).cast("int")
        )
    )
    counts = {(r["class"], r.bucket): r.n for r in cuts.groupBy("class", "bucket").agg(F.count("*").alias("n")).collect()}
    demand = np.zeros(slots, np.int64)
    for (k, _), n in counts.items():
        demand[k - 1] += n
    # where each pattern's places for a class begin: (class, first rank, pieces a sequence, first sequence, place)
    seats, first, taken = [], 0, np.zeros(slots, np.int64)
    for pattern, often in generate_columns(demand):
        for k in np.flatnonzero(pattern):
            seats.append((int(k) + 1, int(taken[k]), int(pattern[k]), first))
            taken[k] += pattern[k] * often
        first += often
    before, base = {}, {}
    for (k, b), n in sorted(counts.items()):
        base[(k, b)] = before.get(k, 0)
        before[k] = base[(k, b)] + n

    # at most classes x buckets rows, and classes x patterns rows: both are bounded by the rule
    bases = spark.createDataFrame([(k, b, n) for (k, b), n in base.items()], "class int, bucket int, base long")
    by_class: dict[int, list] = {}
    for k, *seat in seats:
        by_class.setdefault(k, []).append(tuple(seat))
    table = spark.createDataFrame(
        sorted(by_class.items()), "class int, seats array<struct<first:long,each:long,sequence:long>>"
    )
    order = [F.col(c).asc() for c in ("id", "start", "ids_crc32", "length", "doc_tokens")]
    ranked = (
        cuts.withColumn("n", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(*order)))
        .join(F.broadcast(bases), ["class", "bucket"])
        .withColumn("rank", F.col("base") + F.col("n") - 1)
        .join(F.broadcast(table), "class")
    )
    seat = F.element_at(F.filter("seats", lambda s: s["first"] <= F.col("rank")), -1)
    placed = ranked.withColumn("seat", seat).select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("seat.sequence") + F.expr("(rank - seat.first) div seat.each")).alias("sequence_id"),
    )
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order)
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset")
    )
