"""Forward-fill of on-change values to a regular time grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import over_series
from tidemark.spec import SeriesSpec


def fill_grid(df: DataFrame, spec: SeriesSpec, channels: Sequence[str], step_seconds: int = 60) -> DataFrame:
    """One row per series and grid time, holding the last value reported at or before it.

    Each reported row owns the grid times from its own slot up to the next report, so
    the grid is unfolded from the rows themselves: no grid join, and a long silent gap
    is the only thing that makes a row unfold widely.
    """

    def build(rows: DataFrame, keyed: SeriesSpec) -> DataFrame:
        return rows.withColumn("_next", F.lead(spec.time).over(keyed.window()))

    joined = over_series(df, spec, build, back=0, ahead=1)
    slot = lambda t: F.ceil(F.unix_micros(t) / (step_seconds * 1_000_000))
    time, after = F.col(spec.time).cast("timestamp"), F.col("_next").cast("timestamp")
    first, last = slot(time), F.coalesce(slot(after) - 1, slot(time))
    unfolded = joined.filter(last >= first).withColumn("_slot", F.explode(F.sequence(first, last)))
    grid = F.timestamp_seconds(F.col("_slot") * step_seconds).alias("grid_time")
    return unfolded.select(*spec.series, grid, *channels)

