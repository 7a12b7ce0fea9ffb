"""Scores built from a row or window and its reconstruction; higher is more anomalous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import gaussian_nll_array, mean_squared_error, total
from tidemark.operators.neighbors import kth_distance


def reconstruction_score(x: Column, rebuilt: Column) -> Column:
    return mean_squared_error(x, rebuilt)


def two_pass_score(x: Column, first: Column, second: Column, alpha: float = 0.5, beta: float = 0.5) -> Column:
    """Blend of the error of the first pass and of the pass over its output."""
    return alpha * mean_squared_error(x, first) + beta * mean_squared_error(x, second)


def last_step_nll(x: Column, mu: Column, logvar: Column, reduce: str = "mean", constant: bool = False) -> Column:
    """Likelihood score of the last step of a window given as array of channel arrays."""
    terms = gaussian_nll_array(F.element_at(x, -1), F.element_at(mu, -1), F.element_at(logvar, -1), constant)
    return total(terms) / F.size(terms) if reduce == "mean" else total(terms)


def sampled_reconstruction_score(df: DataFrame, row_id: str, x: str, samples: str) -> DataFrame:
    """Mean error over an array of sampled reconstructions per row."""
    errors = F.transform(F.col(samples), lambda s: mean_squared_error(F.col(x), s))
    return df.select(row_id, (total(errors) / F.size(errors)).alias("score"))


def realness_residual_score(
    df: DataFrame, bank: DataFrame, row_id: str, x: str, realness: str, lam: float = 0.5
) -> DataFrame:
    """(1-l)(1-realness) + l*residual/mean residual, the residual being the distance to a bank.

    The mean is taken over the whole table, not per batch.
    """
    near = kth_distance(df.select(row_id, x, realness), bank, row_id, x, k=1, out="residual")
    mean = near.agg(F.avg("residual").alias("mean_residual"))
    joined = near.join(F.broadcast(mean))
    score = (1.0 - lam) * (1.0 - F.col(realness)) + lam * F.col("residual") / F.col("mean_residual")
    return joined.select(row_id, score.alias("score"))

