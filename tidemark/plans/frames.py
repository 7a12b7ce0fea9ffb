"""Small helpers for pandas frames and Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Extension-typed columns (Arrow-backed strings) as ordinary objects, so that every
    column goes back to Spark as one array."""
    odd = {c: object for c in frame.columns if pd.api.types.is_extension_array_dtype(frame[c].dtype)}
    return frame.astype(odd) if odd else frame


def group_starts(rows: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Positions of the rows that begin a stretch of equal keys, null being a key of its own."""
    fresh = np.zeros(rows.num_rows, bool)
    fresh[:1] = True
    for key in keys:
        column = rows.column(rows.schema.get_field_index(key))
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(fresh)


def arrow_column(values: np.ndarray) -> pa.Array:
    """A vector as a column, or the lines of a matrix or of matrices as a column of arrays."""
    values = np.ascontiguousarray(values)
    if values.ndim == 1:
        return pa.array(values)
    out = pa.array(values.ravel())
    for size in values.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, size, dtype=np.int32)), out)
    return out


#: Numbers of a sum that one row of a task's part holds.
SLICE = 4096


def summed(rows: DataFrame, width: int, steps: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Add up the vectors of ``width`` numbers that ``steps`` makes of each task's batches.

    A task sends its part in slices. Few slices are added up here, those of wide sums where the slices meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), 0
        for part in steps(batches):
            total += part
            n += 1
        if n:
            cut = [total[i : i + SLICE].tobytes() for i in range(0, width, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(cut, pa.binary())], ["i", "v"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for v in group.column("v"))
        return pa.table({"i": group.column("i").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "i int, v binary")
    if width > SLICE:
        parts = parts.groupBy("i").applyInArrow(add, "i int, v binary")
    out = np.zeros(width)
    for row in parts.collect():
        part = np.frombuffer(row.v)
        out[row.i * SLICE : row.i * SLICE + len(part)] += part
    return out
