"""Causal features and window scores on a stream, with the tail of each series as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.plans.frames import plain
from tidemark.operators.features import ALARM_ROWS, EWMA_SPAN, ROLL_ROWS


def timed(df: DataFrame, column: str, delay: str) -> DataFrame:
    """A watermark on an event-time column; a zone-less time is read as UTC first."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, delay)


def _tail(state: GroupState, channels: Sequence[str]) -> pd.DataFrame:
    """Stored rows, newest last."""
    if not state.exists:
        return pd.DataFrame({c: np.array([], dtype=float) for c in channels})
    flat = np.asarray(state.get[0], dtype=float)
    return pd.DataFrame(flat.reshape(-1, len(channels)), columns=list(channels))


def causal_features(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: Sequence[str], channel: str, tail: int = ALARM_ROWS
) -> DataFrame:
    """Trailing mean, deviation, median, lags, backward difference and EWMA of one channel.

    The state is the last ``tail`` values and the running EWMA, whatever the length of
    the series.  The backward difference stands in for the centred gradient, which
    would need the next row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out_cols = list(dict.fromkeys([*keys, *row_id]))
    made = [f"{channel}_{s}" for s in ("roll_mean", "roll_std", "roll_median", "lag1", "lag5", "roc", "ewma")]
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in out_cols] + [f"`{c}` double" for c in made])
    alpha = 2.0 / (EWMA_SPAN + 1.0)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(list(order)).reset_index(drop=True)
        before = _tail(state, [channel])[channel]
        smooth = state.get[1] if state.exists else None
        x = pd.concat([before, rows[channel].astype(float)], ignore_index=True)
        roll = x.rolling(ROLL_ROWS, min_periods=1)
        smoothed = []
        for v in rows[channel].to_numpy(dtype=float):
            smooth = v if smooth is None else alpha * v + (1.0 - alpha) * smooth
            smoothed.append(smooth)
        table = pd.DataFrame(
            {
                made[0]: roll.mean(),
                made[1]: roll.std().fillna(0.0),
                made[2]: roll.median(),
                made[3]: x.shift(1).fillna(0.0),
                made[4]: x.shift(5).fillna(0.0),
                made[5]: x.diff().fillna(0.0),
            }
        ).iloc[len(before) :].reset_index(drop=True)
        state.update(([float(v) for v in x.iloc[-tail:]], float(smooth)))
        yield pd.concat([plain(rows[out_cols]), table.assign(**{made[6]: smoothed})], axis=1)

    return stream.groupBy(*keys).applyInPandasWithState(
        run, ddl, "tail array<double>, ewma double", "append", GroupStateTimeout.NoTimeout
    )


def score_windows_stream(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    row_id: Sequence[str],
    features: Sequence[str],
    length: int,
    fn: Callable[[np.ndarray], np.ndarray],
) -> DataFrame:
    """Score the sliding windows of a stream with a frozen model.

    The state is the last ``length - 1`` rows of each series.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out_cols = list(dict.fromkeys([*keys, *row_id]))
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in out_cols] + ["score double"])
    names = list(features)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(list(order)).reset_index(drop=True)
        before = _tail(state, names)
        x = np.concatenate([before.to_numpy(dtype=float), rows[names].to_numpy(dtype=float)])
        keep = x[-(length - 1) :] if length > 1 else x[:0]
        state.update(([float(v) for v in keep.ravel()],))
        if len(x) >= length:
            views = np.lib.stride_tricks.sliding_window_view(x, length, axis=0).transpose(0, 2, 1)
            first = max(0, length - 1 - len(before))
            yield plain(rows[out_cols]).iloc[first:].assign(score=np.asarray(fn(views), dtype=float)[-(len(rows) - first) :])

    return stream.groupBy(*keys).applyInPandasWithState(
        run, ddl, "tail array<double>", "append", GroupStateTimeout.NoTimeout
    )


def score_rows_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless scoring: a frozen ``score`` function of a detector applied to a stream."""
    return score(stream)
