"""Thresholds: exact best F1, quantile sweep, cost, and peaks over threshold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import running_sums
from tidemark.plans.sizing import is_large, join_few, join_on
from tidemark.plans.stages import checkpointed

# The sweep band of the laboratory evaluation and the reward table.
SWEEP_LOW, SWEEP_HIGH, SWEEP_STEPS = 0.70, 0.999, 250
REWARD_HIT, REWARD_MISS, REWARD_FALSE, REWARD_QUIET = 1.0, -1.0, -0.3, 0.01
MULTIPLIER_LOW, MULTIPLIER_HIGH, MULTIPLIER_STEP = 0.5, 8.0, 0.1
POT_QUANTILE, POT_RATE, POT_SHAPE_ZERO = 0.98, 1e-3, 1e-6


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return safe_ratio(2.0 * precision * recall, precision + recall)


def flag(score: Column, threshold: Column, strict: bool = False) -> Column:
    """0/1 flag; ``strict`` is the rule of the extreme-value thresholds."""
    return (score > threshold if strict else score >= threshold).cast("int")


def score_cuts(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score with rows and positives at or above it.

    Equal scores are combined before the shuffle, and the running totals go through
    the balanced plan, so neither ties nor a single model make a hot task.
    """
    blocks = df.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    # Rows bound the blocks from above, and counting them needs the keys only.
    sums = {"k": F.col("n"), "tp": F.col("pos")}
    cuts = running_sums(blocks, keys, [score], sums, descending=True, large=is_large(df, keys))
    totals = blocks.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos"), F.max(score).alias("top_score")
    )
    return join_on(cuts, totals, keys)


def best_threshold(cuts: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Threshold of the highest F1 among cuts that flag at most half of the rows.

    No positives, or no cut inside the band: the highest score.  Ties: the higher score.
    """
    half = F.greatest(F.lit(1), F.floor(F.col("n_rows") / 2))
    allowed = (F.col("k") <= half) & (F.col("n_pos") > 0)
    f1 = 2.0 * F.col("tp") / (F.col("k") + F.col("n_pos"))
    best = F.max(F.when(allowed, F.struct(f1.alias("f1"), F.col(score).alias("at"))))
    return cuts.groupBy(*keys).agg(best.alias("_b"), F.max("top_score").alias("_top")).select(
        *keys, F.coalesce(F.col("_b.at"), F.col("_top")).alias("threshold")
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles, one row per (key, prob).

    Small groups use the exact ``percentile`` aggregate.  A large group is never
    gathered: its values are ranked by balanced running counts and only the two
    neighbours of each wanted rank are read.
    """
    rows = df.filter(F.col(value).isNotNull())
    grid = F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("_q").alias("quantile")))
    if not is_large(rows, keys):
        found = rows.groupBy(*keys).agg(F.percentile(value, [float(p) for p in probs]).alias("_q"))
        return found.select(*keys, grid.alias("g")).select(*keys, "g.prob", "g.quantile")

    blocks = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(blocks, keys, [value], {"_upto": F.col("_n")})
    sizes = blocks.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    rank = (F.col("_size") - 1) * F.col("prob")
    low, high = F.col("_low"), F.col("_high")
    # a few wanted ranks per key meet the blocks that hold them
    wanted = sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    wanted = wanted.withColumns({"_low": F.floor(rank), "_high": F.ceil(rank)})
    held = ((low >= first) & (low <= last)) | ((high >= first) & (high <= last))
    near = join_few(ranked, wanted, keys).filter(held)
    at = lambda r: F.max(F.when((r >= first) & (r <= last), F.col(value)))
    picked = near.groupBy(*keys, "prob").agg(
        at(low).alias("_lo"), at(high).alias("_hi"), F.max(rank - low).alias("_part")
    )
    return picked.select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("quantile"))


def cuts_at_thresholds(
    cuts: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str = "score", large: bool | None = None
) -> DataFrame:
    """Counts at given thresholds: rows and positives with score >= threshold.

    A threshold shares the count of the smallest distinct score not below it.  The
    two sides are merged by order and filled backwards, so no pair of them is formed.
    ``thresholds`` has the keys and ``threshold``.
    """
    events = cuts.select(*keys, F.col(score).alias("_at"), F.lit(0).alias("_is_t"), "n", "pos").unionByName(
        thresholds.select(*keys, F.col("threshold").alias("_at"), F.lit(1).alias("_is_t")).withColumns(
            {"n": F.lit(0).cast("long"), "pos": F.lit(0).cast("long")}
        )
    )
    # Among equal values the score blocks come first, so that >= holds.
    order_flag = events.withColumn("_first", -F.col("_is_t"))
    summed = running_sums(order_flag, keys, ["_at", "_first"], {"k": F.col("n"), "tp": F.col("pos")}, True, large)
    found = summed.filter(F.col("_is_t") == 1).select(*keys, F.col("_at").alias("threshold"), "k", "tp")
    totals = cuts.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), F.max("n_pos").alias("n_pos"))
    return join_on(found, totals, keys)


def sweep_probs() -> list[float]:
    return [float(p) for p in np.linspace(SWEEP_LOW, SWEEP_HIGH, SWEEP_STEPS)]


def sweep_threshold(
    df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", digits: int | None = None
) -> DataFrame:
    """Best F1 over a grid of score quantiles; ties keep the lowest threshold."""
    grid = exact_quantiles(df, keys, score, sweep_probs()).select(*keys, F.col("quantile").alias("threshold"))
    if digits is not None:
        grid = grid.withColumn("threshold", F.round("threshold", digits))
    grid = grid.distinct()
    cuts = score_cuts(df, keys, score, label)
    counted = cuts_at_thresholds(cuts, grid, keys, score, is_large(df, keys))
    precision = safe_ratio(F.col("tp"), F.col("k"))
    recall = safe_ratio(F.col("tp"), F.col("n_pos"))
    rated = counted.withColumns({"precision": precision, "recall": recall})
    rated = rated.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return rated.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def cost_threshold(
    df: DataFrame, base: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """Multiplier of a healthy level that maximises the summed reward of alarms.

    ``base`` has the keys and ``base``.  A row alarms when score > multiplier * base.
    """
    steps = round((MULTIPLIER_HIGH - MULTIPLIER_LOW) / MULTIPLIER_STEP)
    factors = [round(MULTIPLIER_LOW + i * MULTIPLIER_STEP, 6) for i in range(steps + 1)]
    options = base.withColumn("multiplier", F.explode(F.array(*[F.lit(f) for f in factors])))
    options = options.withColumn("threshold", F.col("multiplier") * F.col("base"))
    cuts = score_cuts(df, keys, score, label)
    # score > t is counted by ordering the score blocks after an equal threshold.
    counted = _counts_above(cuts, options, keys, score, is_large(df, keys))
    hits, alarms = F.col("tp"), F.col("k")
    reward = (
        REWARD_HIT * hits
        + REWARD_MISS * (F.col("n_pos") - hits)
        + REWARD_FALSE * (alarms - hits)
        + REWARD_QUIET * (F.col("n_rows") - F.col("n_pos") - (alarms - hits))
    )
    rated = counted.withColumn("reward", reward)
    best = F.max_by(
        F.struct("multiplier", "threshold", "reward"), F.struct(F.round("reward", 6), -F.col("multiplier"))
    )
    return rated.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def _counts_above(cuts: DataFrame, options: DataFrame, keys: Sequence[str], score: str, large: bool) -> DataFrame:
    events = cuts.select(
        *keys, F.col(score).alias("_at"), F.lit(0).alias("_is_t"), F.lit(None).cast("double").alias("multiplier"), "n", "pos"
    ).unionByName(
        options.select(*keys, F.col("threshold").alias("_at"), F.lit(1).alias("_is_t"), "multiplier").withColumns(
            {"n": F.lit(0).cast("long"), "pos": F.lit(0).cast("long")}
        )
    )
    summed = running_sums(
        events, keys, ["_at", "_is_t", "multiplier"], {"k": F.col("n"), "tp": F.col("pos")}, True, large
    )
    found = summed.filter(F.col("_is_t") == 1).select(*keys, F.col("_at").alias("threshold"), "multiplier", "k", "tp")
    totals = cuts.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), F.max("n_pos").alias("n_pos"))
    return join_on(found, totals, keys)


def tail_moments(df: DataFrame, keys: Sequence[str], score: str = "score", quantile: float = POT_QUANTILE) -> DataFrame:
    """Level u, rows, and moments of the excesses over u, per key."""
    levels = exact_quantiles(df, keys, score, [quantile]).select(*keys, F.col("quantile").alias("u"))
    joined = join_on(df.select(*keys, score), levels, keys)
    excess = F.when(F.col(score) > F.col("u"), F.col(score) - F.col("u"))
    return joined.groupBy(*keys, "u").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(excess).alias("n_tail"),
        F.avg(excess).alias("tail_mean"),
        F.var_samp(excess).alias("tail_var"),
    )


def fit_tail_by_moments(moments: DataFrame) -> DataFrame:
    """Generalized Pareto shape and scale from mean and variance of the excesses."""
    ratio = F.col("tail_mean") * F.col("tail_mean") / F.col("tail_var")
    return moments.withColumns({"xi": 0.5 * (1.0 - ratio), "sigma": 0.5 * F.col("tail_mean") * (1.0 + ratio)})


def tail_level(u: Column, xi: Column, sigma: Column, n: Column, n_tail: Column, rate: float = POT_RATE) -> Column:
    """Level that is exceeded with the target rate; exponential tail when the shape is 0."""
    exponential = u + sigma * F.ln(n_tail / (rate * n))
    general = u + (sigma / xi) * (F.pow(rate * n / n_tail, -xi) - 1.0)
    return F.when(F.abs(xi) < POT_SHAPE_ZERO, exponential).otherwise(general)


def pot_threshold(
    df: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    quantile: float = POT_QUANTILE,
    rate: float = POT_RATE,
    method: str = "moments",
) -> DataFrame:
    """Peaks-over-threshold level per key with the tail fitted by moments or by likelihood."""
    moments = tail_moments(df, keys, score, quantile)
    fitted = fit_tail_by_moments(moments)
    if method == "likelihood":
        fitted = join_on(moments, fit_tail_by_likelihood(df, moments, keys, score), keys, "left")
    zq = tail_level(F.col("u"), F.col("xi"), F.col("sigma"), F.col("n"), F.col("n_tail"), rate)
    return fitted.select(*keys, "u", "n", "n_tail", "xi", "sigma", zq.alias("zq"))


def _theta(v: Column) -> Column:
    """The searched parameter for v in [-1, 1]: from v < 0 heavy tails, by magnitude, to v > 0 bounded ones."""
    low, high = F.ln(1e-8 / F.col("x_max")), F.ln(1e3 / F.col("x_min"))
    return F.when(v < 0, -F.exp(low - v * (high - low))).otherwise(v * (1.0 - 1e-6) / F.col("x_max"))


def fit_tail_by_likelihood(df: DataFrame, moments: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Maximum-likelihood tail per key by the profile over one parameter.

    With theta = -xi/sigma the likelihood only needs the mean of ln(1 - theta*x), so a grid of theta is rated by plain
    aggregates over the excesses; the grid is refined around its best point until the steps are small.  It covers all
    magnitudes that the excesses can tell apart, evenly in the logarithm.  No task holds a key's excesses.
    """
    levels = moments.select(*keys, "u")
    joined = join_on(df.select(*keys, score), levels, keys)
    excess = joined.filter(F.col(score) > F.col("u")).select(*keys, (F.col(score) - F.col("u")).alias("x"))
    excess = checkpointed(excess)
    span = checkpointed(excess.groupBy(*keys).agg(F.max("x").alias("x_max"), F.min("x").alias("x_min")))
    bounds = span.withColumns({"lo": F.lit(-1.0), "hi": F.lit(1.0)})
    steps = 48
    best = None
    for _ in range(7):
        at = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * (i / steps)
        wide = bounds.select("*", F.array(*[_theta(at(i)) for i in range(steps + 1)]).alias("thetas"))
        logs = F.array(*[F.avg(F.log1p(-F.col("thetas")[i] * F.col("x"))) for i in range(steps + 1)])
        held = [*keys, "x_max", "x_min", "lo", "hi", "thetas"]
        rated = join_on(excess, wide, keys).groupBy(*held).agg(logs.alias("m"))
        flat = rated.select(*held[:-1], F.posexplode(F.arrays_zip("thetas", "m")).alias("i", "g"))
        theta, mean_log = F.col("g.thetas"), F.col("g.m")
        # xi = mean ln(1 - theta x), sigma = -xi/theta; profile log-likelihood per row.
        xi = mean_log
        sigma = F.when(theta != 0, -xi / theta)
        usable = (theta != 0) & (sigma > 0) & (xi > -1.0)
        rated = flat.select(
            *held[:-1], "i", xi.alias("xi"), sigma.alias("sigma"),
            F.when(usable, -F.ln(sigma) - xi - 1.0).otherwise(F.lit(float("-inf"))).alias("ll"),
        )
        best = checkpointed(
            rated.groupBy(*held[:-1]).agg(F.max_by(F.struct("i", "xi", "sigma"), F.struct("ll", -F.col("i"))).alias("b"))
        )
        width = (F.col("hi") - F.col("lo")) / steps
        middle = F.col("lo") + width * F.col("b.i")
        bounds = best.select(
            *keys, "x_max", "x_min",
            F.greatest(F.lit(-1.0), middle - width).alias("lo"), F.least(F.lit(1.0), middle + width).alias("hi"),
        )
    return best.select(*keys, "b.xi", "b.sigma")
