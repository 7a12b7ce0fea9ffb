"""Per-series features: rolling statistics, lags, differences, EWMA, alarm history.

The column functions share a partition key and an order, so Catalyst evaluates them after
a single exchange and a single sort. The whole set is worked out over sorted Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.feature_batches import FeatureBatches
from tidemark.plans.ordered import POS, own_rows, sorted_series
from tidemark.spec import SeriesSpec

# Fixed values of the feature set: window lengths in rows, lag distances, caps.
ROLL_ROWS = 15
LAGS = (1, 5)
EWMA_SPAN = 12
ALARM_ROWS = 60
CORRELATION_ROWS = 30
CORRELATION_MIN_ROWS = 3
VARIANCE_FLOOR = 1e-9
ALARM_CAP = 10_000
COUNTER_WRAP = 256
EWMA_PRECISION = 1e-17

# Columns that no model sees.
META_COLUMNS = ("row_id", "timestamp", "element_id", "subsystem")
LABEL_COLUMNS = ("anomaly", "anomaly_type")
CIRCULAR_COLUMNS = ("alarm", "time_since_alarm", "alarm_freq")
RAW_COUNTER = "heartbeat"


@dataclass(frozen=True)
class FeaturePlan:
    """Which channels get which features."""

    rolling: tuple[str, ...] = ("temperature", "pressure", "voltage", "current", "error_rate")
    lagged: tuple[str, ...] = ("temperature", "voltage", "current")
    changing: tuple[str, ...] = ("temperature", "pressure", "current")
    smoothed: tuple[str, ...] = ("temperature", "current", "error_rate")
    correlated: tuple[str, str] = ("temperature", "current")
    alarm: str | None = "alarm"
    counter: str | None = "heartbeat"
    quality: str | None = "quality_flag"
    error: str | None = "error_rate"
    volt: str | None = "voltage"
    roll_rows: int = ROLL_ROWS
    lags: tuple[int, ...] = LAGS
    span: int = EWMA_SPAN
    alarm_rows: int = ALARM_ROWS
    corr_rows: int = CORRELATION_ROWS

    def made(self) -> set[str]:
        """Names of all columns that ``add_features`` appends under this plan."""
        out = {f"{c}_roll_{kind}" for c in self.rolling for kind in ("mean", "std", "median")}
        out |= {f"{c}_lag{n}" for c in self.lagged for n in self.lags}
        out |= {f"{c}_{kind}" for c in self.changing for kind in ("roc", "grad")}
        out |= {f"{c}_ewma" for c in self.smoothed} | {"temp_curr_corr"}
        out |= {"time_since_alarm", "alarm_freq"} if self.alarm else set()
        out |= {"heartbeat_delta"} if self.counter else set()
        out |= {"temp_volt_interaction"} if self.volt else set()
        out |= {"pres_temp_interaction"} if "pressure" in self.rolling else set()
        return out | ({"sensor_health"} if self.counter and self.error and self.quality else set())


def trailing(w: Window, rows: int):
    return w.rowsBetween(-(rows - 1), Window.currentRow)


def rolling_columns(channels: Sequence[str], w, rows: int = ROLL_ROWS) -> dict[str, Column]:
    """Trailing mean, sample deviation (0 for a single row) and median."""
    frame = trailing(w, rows)
    out: dict[str, Column] = {}
    for c in channels:
        out[f"{c}_roll_mean"] = F.avg(c).over(frame)
        out[f"{c}_roll_std"] = F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0))
        out[f"{c}_roll_median"] = _middle(F.sort_array(F.collect_list(c).over(frame)))
    return out


def _middle(ordered: Column) -> Column:
    """The median of a sorted array, null if it is empty; a short frame is sorted faster than counted."""

    def between(x: Column) -> Column:
        n = F.size(x)
        return (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) * 0.5

    return F.get(F.transform(F.array(ordered), between), F.lit(0))


def lag_columns(channels: Sequence[str], w, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"{c}_lag{n}": F.coalesce(F.lag(c, n).over(w), F.lit(0.0)) for c in channels for n in lags}


def change_column(channel: str, w) -> Column:
    """First difference; 0 at the start of the series."""
    return F.coalesce(F.col(channel) - F.lag(channel).over(w), F.lit(0.0))


def gradient_column(channel: str, w) -> Column:
    """Central difference, one-sided at the ends, 0 for a lone row.  Looks one row ahead."""
    x, prev, nxt = F.col(channel), F.lag(channel).over(w), F.lead(channel).over(w)
    return (
        F.when(prev.isNull() & nxt.isNull(), 0.0)
        .when(prev.isNull(), nxt - x)
        .when(nxt.isNull(), x - prev)
        .otherwise((nxt - prev) / 2.0)
    )


EWMA_FAN = 4


def ewma_strides(span: int = EWMA_SPAN) -> list[int]:
    """Distances of the lags that are added up, until an older value cannot be seen any more."""
    keep = 1.0 - 2.0 / (span + 1.0)
    strides = [1]
    while keep ** (strides[-1] * EWMA_FAN) > EWMA_PRECISION:
        strides.append(strides[-1] * EWMA_FAN)
    return strides


def ewma_reach(span: int = EWMA_SPAN) -> int:
    """Rows back that an exponential average reads."""
    return sum(s * (EWMA_FAN - 1) for s in ewma_strides(span))


def add_ewma(rows: DataFrame, keyed: SeriesSpec, channels: Sequence[str], span: int = EWMA_SPAN) -> DataFrame:
    """Add y = a*x + (1-a)*y' per channel, started at the first value of the series.

    The recursion is a geometric sum.  A sum over 4n terms is four lagged sums over n
    terms, so a few rounds of plain lags reach as far back as a double can resolve;
    every round reads the same sorted partitions.  ``rows`` must carry ``_pos``.
    """
    alpha = 2.0 / (span + 1.0)
    keep = 1.0 - alpha
    w = keyed.window()
    start = F.col(POS) == 1
    out = rows.withColumns({f"{c}_ewma": F.when(start, F.col(c)).otherwise(alpha * F.col(c)) for c in channels})
    for stride in ewma_strides(span):
        added = {}
        for c in channels:
            name = f"{c}_ewma"
            terms = [
                F.lit(keep ** (stride * i)) * F.coalesce(F.lag(name, stride * i).over(w), F.lit(0.0))
                for i in range(1, EWMA_FAN)
            ]
            added[name] = sum(terms, F.col(name))
        out = out.withColumns(added)
    return out


def since_alarm_column(alarm: str, w, pos: str = POS, cap: int = ALARM_CAP) -> Column:
    """Rows since the alarm was last on, capped; the cap before the first alarm."""
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_on = F.max(F.when(F.col(alarm) == 1, F.col(pos))).over(upto)
    return F.least(F.coalesce(F.col(pos) - last_on, F.lit(cap)), F.lit(cap)).cast("double")


def alarm_rate_column(alarm: str, w, rows: int = ALARM_ROWS) -> Column:
    return F.avg(F.col(alarm).cast("double")).over(trailing(w, rows))


def rolling_correlation_column(a: str, b: str, w, rows: int = CORRELATION_ROWS) -> Column:
    """Trailing correlation from moments, variances floored, clipped to [-1, 1], else 0."""
    frame = trailing(w, rows)
    x, y = F.col(a), F.col(b)
    mx, my = F.avg(x).over(frame), F.avg(y).over(frame)
    var_x = F.avg(x * x).over(frame) - mx * mx
    var_y = F.avg(y * y).over(frame) - my * my
    cov = F.avg(x * y).over(frame) - mx * my
    scale = F.sqrt(F.greatest(var_x, F.lit(VARIANCE_FLOOR)) * F.greatest(var_y, F.lit(VARIANCE_FLOOR)))
    clipped = F.greatest(F.least(cov / scale, F.lit(1.0)), F.lit(-1.0))
    enough = F.count(F.lit(1)).over(frame) >= CORRELATION_MIN_ROWS
    return F.when(enough, F.coalesce(clipped, F.lit(0.0))).otherwise(0.0)


def counter_delta_column(counter: str, w, wrap: int = COUNTER_WRAP) -> Column:
    """Step of a wrapping counter; 1 for the first row, 0 when it is frozen."""
    step = F.col(counter).cast("double") - F.lag(F.col(counter).cast("double")).over(w)
    return F.coalesce(F.when(step < 0, step + wrap).otherwise(step), F.lit(1.0))


def health_column(error: str, quality: str, delta: Column) -> Column:
    """Composite of error rate, data quality and a frozen counter; higher is healthier."""
    err = F.greatest(F.least(F.col(error), F.lit(1.0)), F.lit(0.0))
    qual = F.greatest(F.least(F.col(quality).cast("double"), F.lit(2.0)), F.lit(0.0))
    raw = 1.0 - err - 0.3 * qual - 0.5 * F.when(delta == 0, 1.0).otherwise(0.0)
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(-2.0))


def feature_reach(plan: FeaturePlan) -> int:
    reach = max(plan.roll_rows, plan.corr_rows, plan.alarm_rows, *plan.lags, ewma_reach(plan.span))
    return max(reach, ALARM_CAP if plan.alarm else 0)


def add_features(df: DataFrame, spec: SeriesSpec, plan: FeaturePlan = FeaturePlan()) -> DataFrame:
    """Append every feature of the plan; missing values become 0.

    The rows of a series meet sorted in one task, which works through them batch by batch.
    """

    cut, keyed = sorted_series(df, spec, back=feature_reach(plan), ahead=1)
    position = POS if POS in cut.columns else None
    frames = max(plan.roll_rows, plan.corr_rows, plan.alarm_rows, *plan.lags, ewma_reach(plan.span))
    work = FeatureBatches(
        plan, keyed.series, position, frames, tuple(ewma_strides(plan.span)), EWMA_FAN, ALARM_CAP, COUNTER_WRAP,
        VARIANCE_FLOOR, CORRELATION_MIN_ROWS,
    )
    kinds = T.StructType([*cut.schema.fields, *[T.StructField(c, T.DoubleType(), False) for c in work.names()]])
    out = own_rows(cut.mapInArrow(work.run, kinds))
    temp = plan.correlated[0]
    if plan.volt:
        out = out.withColumn("temp_volt_interaction", F.col(temp) * F.col(plan.volt))
    if "pressure" in plan.rolling:
        out = out.withColumn("pres_temp_interaction", F.col("pressure") * F.col(temp))
    if plan.counter and plan.error and plan.quality:
        out = out.withColumn("sensor_health", health_column(plan.error, plan.quality, F.col("heartbeat_delta")))
    # the batches have filled what they made
    return out.na.fill(0.0, [c for c in out.columns if c not in set(work.names())])


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that a model may see: no metadata, labels, raw counter or alarm history."""
    hidden = {*META_COLUMNS, *LABEL_COLUMNS, *CIRCULAR_COLUMNS, RAW_COUNTER}
    return [f.name for f in df.schema if f.name not in hidden and isinstance(f.dataType, T.NumericType)]


def engineered_columns(df: DataFrame, plan: FeaturePlan = FeaturePlan()) -> list[str]:
    """The columns of the table that the plan makes."""
    return [c for c in df.columns if c in plan.made()]


def refuse_leakage(features: Sequence[str]) -> None:
    """Raise when a label or alarm column is about to be used as a model input."""
    leaked = sorted(set(features) & {*LABEL_COLUMNS, *CIRCULAR_COLUMNS, "label"})
    if leaked:
        raise ValueError(f"label or alarm columns cannot be model inputs: {leaked}")


def drop_labels(df: DataFrame) -> DataFrame:
    """The table as an unsupervised model may see it."""
    return df.drop(*LABEL_COLUMNS)


def feature_array(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """One array of doubles per row, missing values as 0."""
    refuse_leakage(features)
    return df.withColumn(out, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))
