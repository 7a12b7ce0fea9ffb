"""Anomalous segments and point-adjusted flags.

Segments are cut per series; a run of labels never continues into another series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.ordered import POS, over_series, running_sums
from tidemark.plans.sizing import is_large, join_on
from tidemark.spec import SeriesSpec


def number_segments(df: DataFrame, spec: SeriesSpec, label: str = "label") -> DataFrame:
    """Add the position and the number of the labelled run; null outside of runs."""

    def build(rows: DataFrame, keyed: SeriesSpec) -> DataFrame:
        before = F.coalesce(F.lag(label).over(keyed.window()), F.lit(0))
        return rows.withColumn("_start", ((F.col(label) == 1) & (before != 1)).cast("long"))

    large = is_large(df, spec.series)
    marked = over_series(df, spec, build, back=1, large=large)
    numbered = running_sums(marked, spec.series, spec.order, {"segment": F.col("_start")}, large=large)
    return numbered.withColumn("segment", F.when(F.col(label) == 1, F.col("segment"))).drop("_start")


def segment_table(df: DataFrame, spec: SeriesSpec, label: str = "label") -> DataFrame:
    """One row per labelled run with its 0-based start and exclusive end."""
    runs = number_segments(df, spec, label).filter(F.col("segment").isNotNull())
    return runs.groupBy(*spec.series, "segment").agg(
        (F.min(POS) - 1).alias("start"), F.max(POS).alias("end"), F.count(F.lit(1)).alias("n_rows")
    )


def point_adjust(
    df: DataFrame, spec: SeriesSpec, label: str = "label", predicted: str = "predicted", out: str = "adjusted"
) -> DataFrame:
    """Flag a whole labelled run as soon as one of its rows is flagged."""
    runs = number_segments(df, spec, label)
    if not is_large(df, spec.series):
        hit = F.max(predicted).over(Window.partitionBy(*spec.series, "segment"))
        adjusted = runs.withColumn(out, F.when(F.col("segment").isNotNull(), hit).otherwise(F.col(predicted)))
        return adjusted.drop(POS, "segment")
    hits = runs.filter(F.col("segment").isNotNull()).groupBy(*spec.series, "segment")
    hits = hits.agg(F.max(predicted).alias("_hit"))
    # rows outside of runs stay as they are, and so do not meet under one null key
    inside = join_on(runs.filter(F.col("segment").isNotNull()), hits, [*spec.series, "segment"])
    adjusted = inside.withColumn(out, F.col("_hit")).drop("_hit")
    rest = runs.filter(F.col("segment").isNull()).withColumn(out, F.col(predicted))
    return adjusted.unionByName(rest).drop(POS, "segment")


def adjusted_counts(
    numbered: DataFrame, spec: SeriesSpec, groups: Sequence[str], label: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """Confusion counts after point adjustment, from run totals instead of adjusted rows.

    ``numbered`` comes from ``number_segments``; rows combine before the shuffle, so a
    run may be as long as a whole series.
    """
    per_run = numbered.groupBy(*groups, *spec.series, "segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(predicted).alias("hit"),
        F.sum(F.col(predicted).cast("long")).alias("flagged"),
    )
    inside = F.col("segment").isNotNull()
    return per_run.groupBy(*groups).agg(
        F.sum(F.when(inside & (F.col("hit") == 1), F.col("n")).otherwise(0)).alias("pa_tp"),
        F.sum(F.when(~inside, F.col("flagged")).otherwise(0)).alias("pa_fp"),
        F.sum(F.when(inside & (F.col("hit") != 1), F.col("n")).otherwise(0)).alias("pa_fn"),
    )
