"""Sliding windows, splits, positions and the way back from window scores to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.thresholds import exact_quantiles
from tidemark.plans.frames import arrow_column, group_starts, summed
from tidemark.plans.ordered import CHUNK, POS, over_series, sorted_series, with_length, with_position
from tidemark.plans.sizing import is_large, join_on
from tidemark.spec import SeriesSpec

#: Most windows that a function gets at once.
WINDOW_BATCH = 4096


def temporal_split(df: DataFrame, spec: SeriesSpec, fraction: float = 0.6, out: str = "is_train") -> DataFrame:
    """Mark the first floor(n * fraction) rows of every series as training rows."""
    placed = with_length(with_position(df, spec), spec)
    return placed.withColumn(out, (F.col(POS) <= F.floor(F.col("_len") * fraction)).cast("int")).drop(POS, "_len")


def time_bucket(df: DataFrame, spec: SeriesSpec, rows: int = 500, out: str = "bucket") -> DataFrame:
    """Number the consecutive blocks of ``rows`` positions in each series."""
    placed = with_position(df, spec)
    return placed.withColumn(out, F.floor((F.col(POS) - 1) / rows).cast("long"))


def stable_row_id(df: DataFrame, spec: SeriesSpec, out: str = "row_id") -> DataFrame:
    """Consecutive id over (series, order): position plus the sizes of the earlier series.

    The sizes are one row per series; their running total goes through the same
    balanced plan as any other running total.
    """
    from tidemark.plans.ordered import running_sums

    sizes = df.groupBy(*spec.series).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_sums(sizes, [], list(spec.series), {"_upto": F.col("_n")})
    offsets = offsets.select(*spec.series, (F.col("_upto") - F.col("_n")).alias("_before"))
    placed = join_on(with_position(df, spec), offsets, spec.series)
    return placed.withColumn(out, (F.col("_before") + F.col(POS) - 1).cast("long")).drop(POS, "_before")


def sliding_windows(
    df: DataFrame, spec: SeriesSpec, features: Sequence[str], length: int, stride: int = 1, label: str | None = None
) -> DataFrame:
    """One row per window: keys, row id and label of its last step, and the steps as arrays.

    A window never crosses a series; a series shorter than ``length`` has none.
    """

    def build(rows: DataFrame, keyed: SeriesSpec) -> DataFrame:
        frame = keyed.window().rowsBetween(-(length - 1), Window.currentRow)
        step = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
        return rows.withColumn("win", F.collect_list(step).over(frame)).filter(ends_window(F.col(POS), length, stride))

    keep = dict.fromkeys([*spec.series, *spec.order, *spec.row_id, *features, *([label] if label else [])])
    out = over_series(df.select(*keep), spec, build, back=length - 1)
    meta = dict.fromkeys([*spec.series, *spec.row_id, *([label] if label else [])])
    return out.select(*meta, window_number(F.col(POS), length).alias("window_no"), "win")


def ends_window(pos: Column, length: int, stride: int = 1) -> Column:
    """True on the last step of a window."""
    return (pos >= length) & ((pos - length) % stride == 0)


def window_number(pos: Column, length: int) -> Column:
    """0-based number of the dense window that ends here."""
    return (pos - length).cast("long")


def stride_subset(windows: DataFrame, stride: int) -> DataFrame:
    """The windows that the given stride would have produced, out of the dense ones."""
    return windows.filter(F.col("window_no") % stride == 0)


@dataclass(frozen=True)
class WindowBatches:
    """What a task needs to walk sorted rows batch by batch, with the last ``length - 1`` rows of the batch before."""

    keys: tuple[str, ...]
    channels: tuple[str, ...]
    length: int
    stride: int
    most: int

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Rows that end a window, with the windows as lines of steps; at most ``most`` at a time."""
        for rows, ends, steps in self.walk(batches):
            width = steps.shape[1]
            views = np.lib.stride_tricks.sliding_window_view(steps.ravel(), self.length * width)[::width]
            for first in range(0, len(ends), self.most):
                part = ends[first : first + self.most]
                yield rows.take(pa.array(part)), views[part - (self.length - 1)]

    def walk(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """The rows of a batch behind those carried to it, the places at which a window ends, and the channels of all rows."""
        tail, index0 = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if tail is None else pa.concat_batches([tail, batch])
            old, at = rows.num_rows - batch.num_rows, np.arange(rows.num_rows)
            starts = np.full(rows.num_rows, -(1 << 60))
            fresh = group_starts(rows, self.keys)
            starts[fresh] = fresh
            if old:
                starts[0] = -index0
            index = at - np.maximum.accumulate(starts)
            pos = index + 1
            if POS in rows.schema.names:
                pos = rows.column(rows.schema.get_field_index(POS)).to_numpy(zero_copy_only=False)
            ends = (index >= self.length - 1) & (at >= old) & ((pos - self.length) % self.stride == 0)
            if "_own" in rows.schema.names:
                ends &= rows.column(rows.schema.get_field_index("_own")).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(ends)
            if len(ends):
                columns = [rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in self.channels]
                yield rows, ends, np.column_stack(columns)
            left = max(0, rows.num_rows - (self.length - 1))
            tail, index0 = (rows.slice(left), int(index[left])) if left < rows.num_rows else (None, 0)


def dealt_windows(
    df: DataFrame, spec: SeriesSpec, features: Sequence[str], length: int, stride: int, most: int = WINDOW_BATCH
) -> tuple[DataFrame, WindowBatches]:
    """Rows dealt out by series and sorted once, with their channels as ``_x0..``, and how a task walks them.

    Long series come in chunks of positions with a lead-in, so that no task holds a whole one.
    """
    id_cols = list(dict.fromkeys([*spec.series, *spec.row_id]))
    names = list(features)
    # Everything a task needs travels as plain columns; "_x0.." keeps ids and features apart.
    step = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(names)]
    slim = df.select(*dict.fromkeys([*id_cols, *spec.order]), *step)
    dealt, keyed = sorted_series(slim, spec, back=length - 1)
    channels = tuple(f"_x{i}" for i in range(len(names)))
    carried = [c for c in (CHUNK, POS, "_own") if c in dealt.columns]
    dealt = dealt.select(*id_cols, *carried, *channels)
    return dealt, WindowBatches(tuple(keyed.series), channels, length, stride, most)


def map_windows(
    df: DataFrame,
    spec: SeriesSpec,
    features: Sequence[str],
    length: int,
    fn: Callable[[np.ndarray], dict[str, np.ndarray]],
    schema: dict[str, str],
    stride: int = 1,
    chunk_rows: int = WINDOW_BATCH,
) -> DataFrame:
    """Apply ``fn`` to batches of at most ``chunk_rows`` windows ``(n, length, n_features)`` without storing them.

    A task walks its sorted rows in Arrow batches and carries ``length - 1`` rows from one to the next; the windows of
    a batch are copied for ``fn`` only.
    """
    dealt, work = dealt_windows(df, spec, features, length, stride, chunk_rows)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
        for rows, flat in work.run(batches):
            yield rows, fn(flat.reshape(len(flat), length, -1))

    return _made_windows(df, dealt, spec, made, schema)


def map_series(
    df: DataFrame,
    spec: SeriesSpec,
    features: Sequence[str],
    length: int,
    fn: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]],
    schema: dict[str, str],
) -> DataFrame:
    """As ``map_windows``, for values that neighbouring windows share.

    ``fn`` gets the channels ``(rows, n_features)`` of a batch and the places at which windows end. The windows of these places
    lie in the batch; other rows may follow on rows of another series.
    """
    dealt, work = dealt_windows(df, spec, features, length, 1)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
        for rows, ends, steps in work.walk(batches):
            yield rows.take(pa.array(ends)), fn(steps, ends)

    return _made_windows(df, dealt, spec, made, schema)


def _made_windows(df: DataFrame, dealt: DataFrame, spec: SeriesSpec, made, schema: dict[str, str]) -> DataFrame:
    """Ids of the rows that end a window, with what was made of it."""
    id_cols = list(dict.fromkeys([*spec.series, *spec.row_id]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in made(batches):
            yield pa.RecordBatch.from_arrays(
                [*rows.select(id_cols).columns, *[arrow_column(found[c]) for c in schema]], [*id_cols, *schema]
            )

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in id_cols] + [f"`{c}` {t}" for c, t in schema.items()])
    return dealt.mapInArrow(run, ddl)


def window_sums(
    df: DataFrame, spec: SeriesSpec, features: Sequence[str], length: int, stride: int, width: int,
    step: Callable[[np.ndarray], np.ndarray],
) -> np.ndarray:
    """Add up ``step(windows)`` over all flattened windows in the tasks that make them."""
    dealt, work = dealt_windows(df, spec, features, length, stride)
    return summed(dealt, width, lambda batches: (step(flat) for _, flat in work.run(batches)))


def score_windows(
    df: DataFrame,
    spec: SeriesSpec,
    features: Sequence[str],
    length: int,
    fn: Callable[[np.ndarray], np.ndarray],
    chunk_rows: int = WINDOW_BATCH,
) -> DataFrame:
    """Score every window with a user function ``(n, length, n_features) -> (n,)``."""
    return map_windows(
        df, spec, features, length, lambda x: {"score": np.asarray(fn(x), dtype=float)}, {"score": "double"},
        chunk_rows=chunk_rows,
    )


def scores_to_rows(rows: DataFrame, scores: DataFrame, row_id: Sequence[str], fill: float | None = None) -> DataFrame:
    """Give each row its window score; rows that end no window get ``fill``.

    Without a given fill the 1st percentile of the window scores is used.
    """
    joined = rows.join(scores.select(*row_id, "score"), list(row_id), "left")
    if fill is not None:
        return joined.withColumn("score", F.coalesce("score", F.lit(float(fill))))
    low = exact_quantiles(scores.select("score"), [], "score", [0.01]).select(F.col("quantile").alias("_fill"))
    return joined.join(F.broadcast(low)).withColumn("score", F.coalesce("score", "_fill")).drop("_fill")


def align_scores(rows: DataFrame, scores: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Give each row its window score; the head of a series repeats its first score."""
    joined = rows.join(scores.select(*spec.row_id, "score"), list(spec.row_id), "left")
    if not is_large(rows, spec.series):
        whole = spec.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return joined.withColumn("score", F.coalesce("score", F.first("score", ignorenulls=True).over(whole)))
    order = F.struct(*spec.order)
    first = joined.filter(F.col("score").isNotNull()).groupBy(*spec.series)
    first = first.agg(F.min_by("score", order).alias("_first"))
    return join_on(joined, first, spec.series, "left").withColumn("score", F.coalesce("score", "_first")).drop("_first")
