"""Filter interaction audit: what each filter removes at each step of each order, kept up by a stream with retractions.

All files are read as available-now micro-batches. Equal texts fail the same text filters, so that a text's mask is known
where it is read; only whether a smaller id holds the same text depends on other rows. The keyed state of a text is its
least id so far with the counts of the rows that have it. A row above the least id fails the last filter for good; the
rows at the least id are counted as passing it, and when a smaller id arrives, they are taken back from the counter of
their mask and added to that of the mask with the last filter's bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import sha256
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.llm.common import removed, shared_folder
from tidemark.llm.text import mix, parts, span_hashes, utf8, word_places

@dataclass(frozen=True)
class TextCounts:
    """Per text: words, distinct words, code points, those in A-Z and those in ``#$%&*|``."""

    words: np.ndarray
    distinct: np.ndarray
    chars: np.ndarray
    upper: np.ndarray
    marks: np.ndarray


Filter = tuple[str, Callable[[TextCounts], np.ndarray]]

# The failure conditions of the text filters. The last filter, of copies, follows them.
TEXT_FILTERS: tuple[Filter, ...] = (
    ("A", lambda t: t.words < 200),
    ("B", lambda t: 100 * t.distinct < 50 * t.words),
    ("C", lambda t: 100 * t.upper > 2 * t.chars),
    ("D", lambda t: t.marks > 0),
)
COPIES = "E"

_UPPER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_MARK[[ord(c) for c in "#$%&*|"]] = True

#: Kept while a stream runs: state in a local store with bounded memory, backed by the shared folder.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a manifest would take 4 MB of disk in advance, for every partition
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def document_stream(spark: SparkSession, path: str, batches: int = 4) -> DataFrame:
    """The files below ``path`` as a stream of about ``batches`` micro-batches, a file being the least that one reads."""
    still = spark.read.parquet(path)
    files = max(1, -(-len(still.inputFiles()) // batches))
    # a stream reads a single file only if a pattern names it
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(still.schema).option("maxFilesPerTrigger", files).parquet(pattern)


def slots_for(rows: int) -> int:
    """Slots for a table of about so many rows: a slot's texts are looked at together, some hundred of them."""
    return max(8, rows // 512)


def counted(column: pa.Array) -> TextCounts:
    """The counts of whole texts; null is empty. Words of a text are told apart by 64-bit hashes."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    starts, ends, rows = word_places(data, offsets)
    h = span_hashes(data, starts, ends)
    _, first = np.unique(mix(h ^ mix(rows.astype(np.uint64))), return_index=True)

    def per_text(hit: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[offsets])

    return TextCounts(
        np.bincount(rows, minlength=n),
        np.bincount(rows[first], minlength=n),
        per_text((data & 0xC0) != 0x80),
        per_text(_UPPER[data]),
        per_text(_MARK[data]),
    )


def masked(
    docs: DataFrame,
    labels: DataFrame,
    filters: Sequence[Filter] = TEXT_FILTERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """(id, part, key, mask, good, toxic): bit i of ``mask`` tells whether text filter i fails; ``key`` is the text's digest."""
    d = docs.select(
        docs[id_col].alias("id"),
        F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        docs[text_col].alias("body"),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "body"):
            counts = counted(batch["body"])
            mask = sum(fails(counts).astype(np.int32) << i for i, (_, fails) in enumerate(filters))
            keys = [sha256((text or "").encode()).digest()[:16] for text in batch["body"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["part"], pa.array(keys, pa.binary()), pa.array(mask, pa.int32())],
                names=["id", "part", "key", "mask"],
            )

    kind = d.schema["id"].dataType.simpleString()
    d = d.mapInArrow(read, f"id {kind}, part string, key binary, mask int")
    own = labels.select(labels[id_col].alias("id"), "quality", "toxic").filter("id is not null").groupBy("id")
    own = own.agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rated = d.join(own, "id", "left")
    return rated.withColumns({"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))})


def _combined(rows: DataFrame, bit: int, slots: int) -> DataFrame:
    """The rows of each Arrow batch, added up before they are sent to the slots of their texts.

    Rows above their text's least id in the batch fail the last filter whatever comes, and rows without an id never do:
    both are counts already and take no part in the state. They have no key and a negative slot.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch["key"].dictionary_encode().indices.to_numpy()
            rank = pc.rank(batch["id"], sort_keys="ascending", null_placement="at_end", tiebreaker="dense")
            rank = rank.to_numpy().astype(np.int64)
            known = batch["id"].is_valid().to_numpy(zero_copy_only=False)
            least = np.full(code.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, code[known], rank[known])
            candidate = known & (rank == least[code])
            frame = pd.DataFrame(
                {
                    "code": np.where(candidate, code, -1),
                    "row": np.arange(len(code)),
                    "part": batch["part"].to_pandas(),
                    "good": batch["good"].to_numpy(),
                    "toxic": batch["toxic"].to_numpy(),
                    "mask": batch["mask"].to_numpy() | np.where(known & ~candidate, bit, 0),
                }
            )
            sums = frame.groupby(["code", "part", "good", "toxic", "mask"], sort=False)["row"].agg(["min", "size"]).reset_index()
            first = pa.array(sums["min"].to_numpy())
            settled = pa.array((sums["code"] < 0).to_numpy())
            slot = np.array([int.from_bytes(key[:8]) % slots for key in batch["key"].take(first).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    pc.if_else(settled, pa.scalar(-1 - int(slot[0])), pa.array(slot)),
                    pc.if_else(settled, pa.scalar(None, pa.binary()), batch["key"].take(first)),
                    pc.if_else(settled, pa.scalar(None, batch["id"].type), batch["id"].take(first)),
                    pa.array(sums["part"], pa.string()),
                    *[pa.array(sums[c].to_numpy(), pa.int32()) for c in ("good", "toxic", "mask")],
                    pa.array(sums["size"].to_numpy(), pa.int64()),
                ],
                names=["slot", "key", "id", "part", "good", "toxic", "mask", "n"],
            )

    return rows.mapInArrow(read, f"slot long, key binary, id {kind}, part string, good int, toxic int, mask int, n long")


_COUNTED = ["part", "good", "toxic", "mask", "n"]


def _settle(stored: pd.DataFrame, came: pd.DataFrame, bit: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows at the least ids of their texts after ``came``, and the changes of the counters."""
    rows = pd.concat([stored.assign(old=True), came.assign(old=False)], ignore_index=True)
    least = rows["id"] == rows.groupby("key")["id"].transform("min")
    above = rows[~least]
    back = above[above["old"]].assign(n=lambda r: -r["n"])
    told = pd.concat([rows[least & ~rows["old"]], back, above.assign(mask=above["mask"] | bit)], ignore_index=True)
    kept = rows[least].groupby(["key", "id", "part", "good", "toxic", "mask"], sort=False, as_index=False)["n"].sum()
    return kept, told.groupby(_COUNTED[:-1], sort=False, as_index=False)["n"].sum()


def changes(rows: DataFrame, bit: int, slots: int) -> DataFrame:
    """The stream of counter changes (part, good, toxic, mask, n) of ``masked`` rows; n is negative where it retracts.

    Texts are dealt to slots by their digest; the state of a slot is a small Arrow table of its texts.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            for batch in batches:
                yield batch.groupby(_COUNTED[:-1], sort=False, as_index=False)["n"].sum()
            return
        stored = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else None
        for batch in batches:
            batch = batch.drop(columns="slot")
            stored, told = _settle(batch.iloc[:0] if stored is None else stored, batch, bit)
            yield told
        table = pa.Table.from_pandas(stored, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))

    return (
        _combined(rows, bit, slots)
        .groupBy("slot")
        .applyInPandasWithState(
            run, "part string, good int, toxic int, mask int, n long", "texts binary", "append", GroupStateTimeout.NoTimeout
        )
    )


@contextmanager
def _kept_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def report(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the letters and step, from counts (part, good, toxic, mask, n).

    The sums over all orders follow from a mask alone: of its failing filters each comes first in an equal share.
    """
    orders = ["".join(p) for p in permutations(letters)]
    size = len(letters)
    bits = {letter: 1 << i for i, letter in enumerate(letters)}
    own = [bits[letter] for order in orders for letter in order]
    before = [sum(bits[letter] for letter in order[:k]) for order in orders for k in range(size)]
    per_mask = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    # as many entries as there are masks
    parts = per_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(own) - 1)))).select(
        "part",
        "masks",
        F.get(F.lit(orders), F.expr(f"at div {size}").cast("int")).alias("filter_order"),
        (F.col("at") % size + 1).alias("step"),
        F.get(F.lit(own), F.col("at")).alias("own"),
        F.get(F.lit(before), F.col("at")).alias("before"),
    )

    def total(pick: Callable[[Column], Column], value: Callable[[Column], Column] = lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("masks", lambda x: pick(x["mask"])), F.lit(0).cast("long"), lambda a, x: a + value(x))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    share = lambda x: F.expr(f"{len(orders)}L") / F.bit_count(x["mask"])
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(lambda m: fails(m) & ~gone(m)).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == F.col("own")).alias("unique_fails"),
        total(lambda m: fails(m) & ~gone(m), lambda x: x["good"]).alias("good_lost"),
        total(lambda m: fails(m) & ~gone(m), lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: x["n"] * share(x).cast("long")).alias("shapley"),
    )


def audit_filters(
    stream: DataFrame,
    labels: DataFrame,
    slots: int,
    filters: Sequence[Filter] = TEXT_FILTERS,
    copies: str = COPIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    folder: str | None = None,
) -> DataFrame:
    """Counts per part, order of the filters and step, over all that ``stream`` has at hand; see ``report``.

    Null texts are empty ones; null parts are ''. A row without an id has no smaller id and is none, so it passes the
    last filter. Repeated rows are rows; those at their text's least id pass alike. An id that ``labels`` holds several
    times is good or toxic if one of its rows says so. Very long texts are read whole. An empty stream gives no row.

    ``slots`` (``slots_for`` the rows to come) bounds what a call looks at. ``folder``, by default a new one in the shared
    folder, holds the stream's state and its output; a run that was stopped goes on when it is given the same folder and
    slots. The state is removed at the end.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    out = changes(masked(stream, labels, filters, id_col, text_col, part_col), 1 << len(filters), slots)
    with _kept_settings(spark, _STORE):
        writer = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start(f"{folder}/changes").awaitTermination()
    removed(spark, f"{folder}/state")
    counts = spark.read.schema(out.schema).parquet(f"{folder}/changes")
    return report(counts, "".join(letter for letter, _ in filters) + copies)
