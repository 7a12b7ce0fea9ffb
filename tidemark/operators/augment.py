"""Labelled fault injection into an existing table.

Faults are closed-form in the position p of a row inside its episode and the episode
length m.  The episodes of a series are gathered with the values that they hold; rows
meet them by the series alone, so telemetry that is dealt out by series is not
shuffled again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.sizing import broadcast_rows_limit, join_few
from tidemark.plans.stages import checkpointed

DAY_STEPS = 1440

# Fixed kinds; each changes the channels listed in ``channel_changes``.
KINDS = (
    "point_anomaly",
    "voltage_spike",
    "temperature_drift",
    "increasing_error_rate",
    "sensor_freeze",
    "communication_loss",
    "collective_anomaly",
    "contextual_anomaly",
    "cooling_failure",
    "persistent_anomaly",
    "cascading_failure",
)
HELD_KINDS = ("sensor_freeze", "communication_loss")
HELD_CHANNELS = ("temperature", "pressure", "voltage", "current")

# Fixed values of the fault shapes.  ``size`` of an episode scales the open parameters.
POINT_JUMP = {"temperature": 6.0, "current": 20.0, "pressure": 0.3}
STEP_OFFSET = {"voltage": 0.15, "current": 8.0, "pressure": 0.08}
DEFAULTS = {
    "drift_current_factor": 1.5,
    "oscillation_period": 6.0,
    "cooling_exponent": 1.3,
    "cooling_pressure": 0.15,
    "cooling_current": 12.0,
    "cooling_quality_from": 0.6,
    "cascade_exponent": 1.5,
    "cascade_lag": 25.0,
    "cascade_temperature": 5.0,
    "cascade_current": 10.0,
    "cascade_tail": 90.0,
    "cascade_sag": 0.12,
    "cascade_quality_from": 0.5,
    "loss_error": 0.2,
    "error_quality_from": 0.3,
    "season_amplitude": 1.0,
    "season_phase": 0.0,
}
# The single-table variant: a longer lag, other amplitudes, a slower oscillation.
LAB_VALUES = {
    **DEFAULTS,
    "oscillation_period": 8.0,
    "cascade_lag": 30.0,
    "cascade_temperature": 2.5,
    "cascade_current": 5.0,
    "cascade_tail": 100.0,
    "cascade_sag": 0.05,
    "season_amplitude": 0.8,
    "season_phase": -0.5,
}


def ramp(p: Column, m: Column, exponent: float = 1.0) -> Column:
    """p/(m-1) raised to an exponent; 0 for an episode of one row and before its start."""
    share = F.when(m > 1, p / (m - 1)).otherwise(0.0)
    return F.pow(F.greatest(share, F.lit(0.0)), F.lit(exponent))


def season_flip(step: Column, amplitude: float, phase: float) -> Column:
    """Difference between the daily cycle shifted by pi and the daily cycle."""
    angle = 2.0 * math.pi * step / DAY_STEPS + phase
    return amplitude * (F.sin(angle + math.pi) - F.sin(angle))


def channel_changes(p: Column, m: Column, step: Column, size: Column, values: Mapping[str, float]) -> dict[tuple[str, str], Column]:
    """Additive change per (kind, channel) at position p of an episode of length m."""
    v = {**DEFAULTS, **values}
    linear = ramp(p, m)
    cooling = ramp(p, m, v["cooling_exponent"])
    cascade = ramp(p, m, v["cascade_exponent"])
    delayed = F.when(p >= v["cascade_lag"], ramp(p - v["cascade_lag"], m, v["cascade_exponent"])).otherwise(0.0)
    tail = F.least(F.lit(v["cascade_tail"]), m)
    into_tail = p - (m - tail)
    sag = F.when(into_tail >= 0, v["cascade_sag"] * ramp(into_tail, tail)).otherwise(0.0)
    return {
        ("voltage_spike", "voltage"): size,
        ("temperature_drift", "temperature"): size * linear,
        ("temperature_drift", "current"): v["drift_current_factor"] * size * linear,
        ("increasing_error_rate", "error_rate"): size * linear,
        ("communication_loss", "error_rate"): F.lit(v["loss_error"]),
        ("collective_anomaly", "current"): size * F.sin(2.0 * math.pi * p / v["oscillation_period"]),
        ("contextual_anomaly", "temperature"): season_flip(step, v["season_amplitude"], v["season_phase"]),
        ("cooling_failure", "temperature"): size * cooling,
        ("cooling_failure", "pressure"): v["cooling_pressure"] * cooling,
        ("cooling_failure", "current"): v["cooling_current"] * cooling,
        ("cascading_failure", "temperature"): v["cascade_temperature"] * cascade,
        ("cascading_failure", "current"): v["cascade_current"] * delayed,
        ("cascading_failure", "voltage"): -sag,
    }


def inject(
    df: DataFrame,
    episodes: DataFrame,
    series: Sequence[str],
    step: str,
    row_id: Sequence[str],
    values: Mapping[str, float] = DEFAULTS,
) -> DataFrame:
    """Apply fault episodes and label the touched rows.

    ``episodes``: series columns, ``episode`` (number), ``kind``, ``channel`` (for point
    and step faults), ``start``, ``end`` (exclusive), ``size`` (amplitude or sign).
    Additive faults of overlapping episodes add up; of held values and type names the
    later episode wins.
    """
    v = {**DEFAULTS, **values}
    met = _meet(df, episodes, series, step)
    channels = [*HELD_CHANNELS, "error_rate"]

    def deltas(e: Column) -> dict[str, Column]:
        p, m = (F.col(step) - e["start"]).cast("double"), (e["end"] - e["start"]).cast("double")
        changes = channel_changes(p, m, F.col(step).cast("double"), e["size"], v)
        out = {}
        for c in channels:
            total = F.lit(0.0)
            for (k, target), change in changes.items():
                if target == c:
                    total = total + F.when(e["kind"] == k, change).otherwise(0.0)
            for kind, jumps in (("point_anomaly", POINT_JUMP), ("persistent_anomaly", STEP_OFFSET)):
                if c in jumps:
                    total = total + F.when((e["kind"] == kind) & (e["channel"] == c), e["size"] * jumps[c]).otherwise(0.0)
            out[c] = total
        return out

    def worse(e: Column) -> Column:
        p, m = (F.col(step) - e["start"]).cast("double"), (e["end"] - e["start"]).cast("double")
        ramped = F.when(e["kind"] == "cooling_failure", ramp(p, m, v["cooling_exponent"]) > v["cooling_quality_from"])
        ramped = ramped.when(e["kind"] == "cascading_failure", ramp(p, m, v["cascade_exponent"]) > v["cascade_quality_from"])
        high = F.col("error_rate") + deltas(e)["error_rate"] > v["error_quality_from"]
        return (
            F.when(e["kind"] == "communication_loss", 2)
            .when(e["kind"] == "sensor_freeze", 1)
            .when(ramped, 1)
            .when((e["kind"] == "increasing_error_rate") & high, 1)
            .otherwise(0)
        )

    def change(c: str) -> Column:
        added = F.aggregate("_hits", F.lit(0.0), lambda sum_, e: sum_ + F.coalesce(deltas(e)[c].cast("double"), F.lit(0.0)))
        return F.coalesce(added, F.lit(0.0))

    def latest(which, *fields: str) -> Column:
        found = F.filter("_hits", lambda e: e["episode"].isNotNull() & which(e))
        return F.array_max(F.transform(found, lambda e: F.struct(e["episode"], *[e[c] for c in fields])))

    lost = F.filter("_hits", lambda e: e["kind"] == "communication_loss")
    touched = met.withColumns(
        {
            "_kind": latest(lambda e: F.lit(True), "kind")["kind"],
            "_quality": F.array_max(F.transform("_hits", worse)),
            "_hold": latest(lambda e: e["kind"].isin(*HELD_KINDS), "start", "held"),
            "_frozen_from": F.array_max(F.transform(lost, lambda e: e["start"])),
        }
    )
    held = F.col("_hold")["held"]
    cols = {c: F.coalesce(held[c], F.col(c)) + change(c) for c in HELD_CHANNELS}
    cols["error_rate"] = F.col("error_rate") + change("error_rate")
    cols["quality_flag"] = F.greatest(F.col("quality_flag"), F.coalesce(F.col("_quality"), F.lit(0)))
    frozen = F.when(F.col("_frozen_from") == F.col("_hold")["start"], held["heartbeat"])
    cols["heartbeat"] = F.coalesce(frozen, F.col("heartbeat"))
    cols["anomaly"] = F.when(F.col("_kind").isNotNull(), 1).otherwise(F.col("anomaly"))
    cols["anomaly_type"] = F.coalesce(F.col("_kind"), F.col("anomaly_type"))
    return touched.withColumns(cols).select(*df.columns)


def _meet(df: DataFrame, episodes: DataFrame, series: Sequence[str], step: str) -> DataFrame:
    """The rows with the episodes of their series that touch them, as ``_hits``.

    The episodes of a series travel as one array with the values that they hold. Rows that are already dealt out by
    series stay where they are; few series are sent to every executor.
    """
    keys = {c: f"_e_{c}" for c in series}
    eps = episodes.withColumnsRenamed(keys).dropna(subset=list(keys.values()))
    starts = eps.filter(F.col("kind").isin(*HELD_KINDS)).select(*keys.values(), "start").distinct()
    last = F.struct(*HELD_CHANNELS, "heartbeat")
    base = df.select(*series, step, last.alias("held"))
    on = F.col(step) == F.col("start") - 1
    for c, k in keys.items():
        on = on & (F.col(c) == F.col(k))
    held = base.join(starts, on).groupBy(*keys.values(), "start").agg(F.min("held").alias("held"))
    fields = [F.col(c) for c in ("episode", "kind", "channel", "start", "end", "size", "held")]
    per = eps.join(held, [*keys.values(), "start"], "left").groupBy(*keys.values())
    per = checkpointed(per.agg(F.collect_list(F.struct(*fields)).alias("_episodes")))
    few = per.limit(broadcast_rows_limit(df.sparkSession) + 1).count() <= broadcast_rows_limit(df.sparkSession)
    same = F.lit(True)
    for c, k in keys.items():
        same = same & (F.col(c) == F.col(k))
    met = df.join(F.broadcast(per) if few else per, same, "left")
    touching = F.filter("_episodes", lambda e: (F.col(step) >= e["start"]) & (F.col(step) < e["end"]))
    return met.withColumn("_hits", touching).drop("_episodes", *keys.values())


def rule_alarm(df: DataFrame, spec_table: DataFrame, error_band: float = 0.15, bad_quality: int = 2) -> DataFrame:
    """The fixed-band alarm: temperature or voltage off their subsystem mean, errors, bad quality.

    ``spec_table``: subsystem, temp_mean, temp_band, voltage_mean, voltage_band.
    """
    # a row without a subsystem meets no line of the table
    joined = join_few(df, spec_table.filter("subsystem IS NOT NULL"), ["subsystem"], "left")
    fired = (
        (F.abs(F.col("temperature") - F.col("temp_mean")) > F.col("temp_band"))
        | (F.abs(F.col("voltage") - F.col("voltage_mean")) > F.col("voltage_band"))
        | (F.col("error_rate") > error_band)
        | (F.col("quality_flag") >= bad_quality)
    )
    return joined.withColumn("rule_alarm", F.coalesce(fired.cast("int"), F.lit(0))).select(*df.columns, "rule_alarm")
