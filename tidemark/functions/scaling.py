"""z-scores with the statistics of a training table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(train: DataFrame, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """One row of means and deviations; a constant column gets deviation 1 when ddof is 0."""
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = train.agg(
        *[F.avg(c).alias(f"{c}_mu") for c in columns], *[spread(c).alias(f"{c}_raw") for c in columns]
    )
    scale = [
        (F.when(F.col(f"{c}_raw") == 0, 1.0).otherwise(F.col(f"{c}_raw")) if ddof == 0 else F.col(f"{c}_raw")).alias(
            f"{c}_sd"
        )
        for c in columns
    ]
    return stats.select(*[f"{c}_mu" for c in columns], *scale)


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its z-score.  The scaler's single row is read once, so later jobs do not fit it anew."""
    row = scaler.first()
    scaled = {
        c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(row[f"{c}_mu"])) / F.lit(row[f"{c}_sd"]) for c in columns
    }
    return df.withColumns(scaled)


@dataclass(frozen=True)
class Standard:
    """A fitted scaler as numbers, for saving it with a model."""

    means: np.ndarray
    deviations: np.ndarray

    @staticmethod
    def of(train: DataFrame, columns: Sequence[str], ddof: int = 0) -> Standard:
        row = fit_scaler(train, columns, ddof).first()
        return Standard(np.array([row[f"{c}_mu"] for c in columns]), np.array([row[f"{c}_sd"] for c in columns]))

    def apply(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Replace each column by its z-score."""
        scaled = zip(columns, self.means.tolist(), self.deviations.tolist())
        return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / d for c, m, d in scaled})
