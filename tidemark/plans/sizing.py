"""Size checks that decide between the plain plan and the split plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_ROWS_CONF = "spark.tidemark.maxGroupRows"
BROADCAST_ROWS_CONF = "spark.tidemark.maxBroadcastRows"

DEFAULT_GROUP_ROWS = 2_000_000
DEFAULT_BROADCAST_ROWS = 200_000


def group_rows_limit(spark: SparkSession) -> int:
    """Most rows one window or one grouped-map task may receive."""
    return int(spark.conf.get(GROUP_ROWS_CONF, str(DEFAULT_GROUP_ROWS)))


def broadcast_rows_limit(spark: SparkSession) -> int:
    """Most rows of a side that may be broadcast to every executor."""
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group, from a map-side combined count over the keys only."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def is_large(df: DataFrame, keys: Sequence[str]) -> bool:
    """True when some group exceeds the configured row limit."""
    return largest_group(df, keys) > group_rows_limit(df.sparkSession)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys, null keys included, keeping the key columns of the left side once.

    Without keys the right side is a global aggregate, that is a single row.
    """
    if not keys:
        return left.join(F.broadcast(right))
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_r_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def join_few(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``join_on`` for a right side of one row per group, such as statistics.

    Few groups are sent to every executor, so that the rows of a large one are not brought together in one task.
    """
    from tidemark.plans.stages import checkpointed

    right = checkpointed(right)
    few = right.limit(broadcast_rows_limit(left.sparkSession) + 1).count() <= broadcast_rows_limit(left.sparkSession)
    return join_on(left, F.broadcast(right) if few else right, keys, how)
