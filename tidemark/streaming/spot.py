"""Adaptive extreme-value threshold, as a batch job and as a stateful stream.

The threshold only moves on rows above the calibration level u.  The batch job therefore
walks just those (about 2 % of the rows); the rows between them inherit the threshold.
A walk is one pass in time order with a constant-size state per key, so a key with a
third of all rows needs no more memory than any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.thresholds import POT_RATE, POT_SHAPE_ZERO, pot_threshold
from tidemark.plans.frames import plain
from tidemark.plans.ordered import POS, running_sums, with_position
from tidemark.plans.sizing import join_on
from tidemark.spec import SeriesSpec

State = tuple[float, float, float, float, float, float]  # u, n, n_tail, sum, sum of squares, z_q


def level(u: float, n: float, count: float, total: float, squares: float, rate: float) -> float:
    """z_q from the running moments of the excesses."""
    mean = total / count
    var = (squares - count * mean * mean) / (count - 1.0) if count > 1 else 0.0
    ratio = mean * mean / var if var > 0 else 1.0
    xi, sigma = 0.5 * (1.0 - ratio), 0.5 * mean * (1.0 + ratio)
    if abs(xi) < POT_SHAPE_ZERO:
        return u + sigma * math.log(count / (rate * n))
    return u + sigma / xi * ((rate * n / count) ** (-xi) - 1.0)


def advance(state: State, score: float, rate: float) -> tuple[State, float, int]:
    """One row: the threshold before the row, the alarm, and the state after it.

    An alarm leaves the state as it was; an excess joins the tail and refits it.
    """
    u, n, count, total, squares, zq = state
    if score > zq:
        return state, zq, 1
    if score > u:
        x = score - u
        n, count, total, squares = n + 1, count + 1, total + x, squares + x * x
        return (u, n, count, total, squares, level(u, n, count, total, squares, rate)), zq, 0
    return (u, n + 1, count, total, squares, zq), zq, 0


def calibrate(calibration: DataFrame, keys: Sequence[str], score: str = "score", rate: float = POT_RATE) -> DataFrame:
    """Initial state per key: u, n, tail count, sums of the excesses, z_q."""
    fitted = pot_threshold(calibration, keys, score, rate=rate)
    joined = join_on(calibration.select(*keys, score), fitted.select(*keys, "u"), keys)
    x = F.when(F.col(score) > F.col("u"), F.col(score) - F.col("u"))
    sums = joined.groupBy(*keys).agg(F.sum(x).alias("total"), F.sum(x * x).alias("squares"))
    state = join_on(fitted, sums, keys)
    double = [F.col(c).cast("double").alias(c) for c in ("u", "n", "n_tail", "total", "squares", "zq")]
    return state.select(*keys, *double)


def spot_batch(
    df: DataFrame, spec: SeriesSpec, initial: DataFrame, score: str = "score", rate: float = POT_RATE
) -> DataFrame:
    """Threshold in force and alarm of every row.

    ``initial`` comes from ``calibrate`` with the series columns as keys.
    """
    keys = list(spec.series)
    slim = list(dict.fromkeys([*keys, *spec.order, *spec.row_id, score]))
    placed = join_on(with_position(df.select(*slim), spec), initial, keys)
    above = running_sums(
        placed, keys, list(spec.order), {"_above": (F.col(score) > F.col("u")).cast("long")}
    ).persist()
    moving = above.filter(F.col(score) > F.col("u")).select(*keys, POS, score, "_above", "u", "n", "n_tail", "total", "squares", "zq")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, seen = None, None, 0.0
        for batch in batches:
            emitted = []
            for row in batch.itertuples(index=False):
                *own, pos, value, rank, u, n, count, total, squares, zq = row
                if own != key:
                    key, state, seen = own, (u, n, count, total, squares, zq), 0.0
                # Rows at or below u since the last walked row only count up n.
                quiet = (pos - rank) - seen
                seen += quiet
                state = (state[0], state[1] + quiet, *state[2:])
                state, before, alarm = advance(state, value, rate)
                emitted.append((*own, pos, before, alarm, state[5]))
            yield pd.DataFrame(emitted, columns=[*keys, POS, "threshold", "alarm", "_next"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{POS} long, threshold double, alarm int, _next double"])
    walked = moving.repartition(*keys).sortWithinPartitions(*keys, POS).mapInPandas(walk, ddl)
    # A row at or below u inherits the threshold after the last walked row before it.
    steps = walked.select(*keys, F.col("alarm"), F.col("threshold"), F.col("_next"), F.col(POS).alias("_at"))
    ranked = above.filter(F.col(score) > F.col("u")).select(*keys, F.col(POS).alias("_at"), "_above")
    after = join_on(ranked, steps, [*keys, "_at"]).select(
        *keys, F.col("_above").alias("_k"), "alarm", "threshold", "_next", "_at"
    )
    joined = join_on(above.withColumn("_k", F.col("_above")), after, [*keys, "_k"], "left")
    here = F.col(POS) == F.col("_at")
    threshold = F.when(here, F.col("threshold")).otherwise(F.coalesce("_next", "zq"))
    return joined.select(
        *dict.fromkeys([*keys, *spec.row_id]),
        threshold.alias("threshold"),
        F.when(here, F.col("alarm")).otherwise(0).alias("alarm"),
    )


STATE_SCHEMA = "u double, n double, n_tail double, total double, squares double, zq double"


def spot_stream(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    row_id: Sequence[str],
    initial: DataFrame,
    score: str = "score",
    rate: float = POT_RATE,
) -> DataFrame:
    """The same operator on a stream, keyed state of six numbers per key.

    The calibrated start is joined as a static side; each micro-batch is put in order
    before the state sees it.
    """
    names = ["u", "n", "n_tail", "total", "squares", "zq"]
    start = initial.select(*keys, *[F.col(c).alias(f"_i_{c}") for c in names])
    joined = stream.join(start, list(keys))
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out_cols = list(dict.fromkeys([*keys, *row_id]))
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in out_cols] + ["threshold double, alarm int"])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(list(order))
        current = tuple(state.get) if state.exists else tuple(float(rows.iloc[0][f"_i_{c}"]) for c in names)
        thresholds, alarms = [], []
        for value in rows[score].to_numpy():
            current, before, alarm = advance(current, float(value), rate)
            thresholds.append(before)
            alarms.append(alarm)
        state.update(tuple(float(v) for v in current))
        yield plain(rows[out_cols]).assign(threshold=thresholds, alarm=alarms)

    return joined.groupBy(*keys).applyInPandasWithState(
        run, ddl, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )

