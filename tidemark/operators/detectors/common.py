"""Shared pieces of the detectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.frames import summed
from tidemark.plans.stages import removed, work_folder


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table on the executors while a fit reads it several times."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def with_vector(df: DataFrame, array: str = "features", out: str = "_vector") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array)))


def literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def stacked(column: pa.Array) -> np.ndarray:
    """Array column of an Arrow batch as a matrix, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float, copy=False)


def batch_column(fn, kind: T.DataType = T.DoubleType()):
    """A column function that applies ``fn`` to the matrix of each Arrow batch."""

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float64()) if isinstance(kind, T.ArrayType) else pa.float64())
        out = np.asarray(fn(stacked(column)), dtype=float)
        if out.ndim == 1:
            return pa.array(out)
        offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return run


def array_size(df: DataFrame, array: str) -> int:
    """Width of the feature arrays, read from one row."""
    row = df.select(F.size(array).alias("n")).first()
    if row is None:
        raise ValueError("cannot fit on an empty table")
    return int(row["n"])


def partition_sums(rows: DataFrame, array: str, width: int, step) -> np.ndarray:
    """Add up ``step(matrix)`` over all batches; partial sums meet in slices."""

    return summed(
        rows.select(array), width, lambda batches: (step(stacked(b.column(0))) for b in batches if b.num_rows)
    )


#: Rows of a block.
PIECE = 2048


def as_blocks(rows: DataFrame, array: str) -> DataFrame:
    """The arrays of each Arrow batch as the bytes of small matrices, for fits that read all rows many times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column(0))
            for at in range(0, batch.num_rows, PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([x[at : at + PIECE].tobytes()], pa.binary())], ["block"])

    return rows.select(array).mapInArrow(run, "block binary")


@contextmanager
def kept_blocks(rows: DataFrame, array: str) -> Iterator[DataFrame]:
    """``as_blocks``, written compressed to the shared folder while a fit reads them many times.

    Blocks of a large table would fill the executors' memory and then lie on their disks as they are. A row group has a few
    blocks, so that a reader holds no more.
    """
    folder = work_folder(rows.sparkSession, "blocks")
    # a writer looks at the size of a page and of a group after every block, not only after a hundred
    kept = {"block.size": 1 << 24, "enable.dictionary": "false", "block.size.row.check.min": 1, "page.size.row.check.min": 1}
    writer = as_blocks(rows, array).write.options(**{f"parquet.{k}": v for k, v in kept.items()})
    writer.option("compression", "zstd").parquet(folder)
    try:
        yield rows.sparkSession.read.schema("block binary").parquet(folder)
    finally:
        removed(rows.sparkSession, folder)


def part_of_blocks(blocks: DataFrame, d: int, share: int) -> DataFrame:
    """About one row in ``share``, drawn by a hash of its values."""
    odd = np.random.default_rng(d).integers(1 << 62, dtype=np.uint64, size=d) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), dtype=float).reshape(-1, d)
                mixed = (x.view(np.uint64) * odd).sum(1, dtype=np.uint64)
                x = x[(mixed ^ mixed >> np.uint64(29)) * odd[0] >> np.uint64(32) < np.uint64((1 << 32) // share)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["block"])

    return blocks.mapInArrow(run, "block binary")


def block_sums(blocks: DataFrame, d: int, width: int, step) -> np.ndarray:
    """``partition_sums`` over blocks of d columns."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for block in batch.column(0):
                yield step(np.frombuffer(block.as_buffer(), dtype=float).reshape(-1, d))

    return summed(blocks, width, steps)
