"""Queries over the per-series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scaling import apply_scaler, fit_scaler
from tidemark.operators import features as feat
from tidemark.operators.segments import point_adjust, segment_table
from tidemark.operators.windows import (
    scores_to_rows,
    align_scores,
    sliding_windows,
    stable_row_id,
    stride_subset,
    temporal_split,
    time_bucket,
)
from tidemark.plans.ordered import over_series
from workload.catalog import query
from workload.roles import (
    EV_W,
    EVENTS,
    EVENTS_SQL,
    SCORED_SQL,
    TEL_IDS,
    TEL_W,
    TELEMETRY,
    TELEMETRY_SQL,
    events,
    scored,
    telemetry,
)

IDS = ", ".join(TEL_IDS)
DYNAMIC = ["temperature", "pressure", "voltage", "current", "error_rate"]


def series_query(spark, sf, make, back, ahead=0):
    """Evaluate named window columns over the telemetry series."""

    def build(rows, keyed):
        return rows.select("*", *[c.alias(n) for n, c in make(keyed.window()).items()])

    return over_series(telemetry(spark, sf), TELEMETRY, build, back, ahead)


def rounded(cols: dict[str, int]):
    return [F.round(F.col(c), d).alias(c) for c, d in cols.items()]


def sql_rounded(cols: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c, d in cols.items())


_ROLL = {f"{c}_roll_{s}": d for c in DYNAMIC for s, d in (("mean", 6), ("std", 3), ("median", 6))}


@query(
    "win_rolling_stats",
    "WIN1",
    f"""WITH {TELEMETRY_SQL}, w AS (SELECT {IDS}, """
    + ", ".join(
        f"avg({c}) OVER r AS {c}_roll_mean, coalesce(stddev_samp({c}) OVER r, 0) AS {c}_roll_std, "
        f"median({c}) OVER r AS {c}_roll_median"
        for c in DYNAMIC
    )
    + f""" FROM tel WINDOW r AS ({TEL_W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
    SELECT {IDS}, {sql_rounded(_ROLL)} FROM w""",
)
def win_rolling_stats(spark, sf):
    out = series_query(spark, sf, lambda w: feat.rolling_columns(DYNAMIC, w), back=14)
    return out.select(*TEL_IDS, *rounded(_ROLL))


_LAGGED = ["temperature", "voltage", "current"]


@query(
    "win_lags",
    "WIN2",
    f"WITH {TELEMETRY_SQL} SELECT {IDS}, "
    + ", ".join(f"coalesce(lag({c}, {n}) OVER w, 0) AS {c}_lag{n}" for c in _LAGGED for n in (1, 5))
    + f" FROM tel WINDOW w AS ({TEL_W})",
)
def win_lags(spark, sf):
    out = series_query(spark, sf, lambda w: feat.lag_columns(_LAGGED, w), back=5)
    return out.select(*TEL_IDS, *[f"{c}_lag{n}" for c in _LAGGED for n in (1, 5)])


_CHANGE = {f"{c}_{s}": 6 for c in ("temperature", "pressure", "current") for s in ("roc", "grad")}


@query(
    "win_rate_of_change_and_gradient",
    "WIN3 WIN4",
    f"WITH {TELEMETRY_SQL}, w AS (SELECT {IDS}, "
    + ", ".join(
        f"""coalesce({c} - lag({c}) OVER w, 0) AS {c}_roc,
        CASE WHEN lag({c}) OVER w IS NULL AND lead({c}) OVER w IS NULL THEN 0
             WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c}
             WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w
             ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS {c}_grad"""
        for c in ("temperature", "pressure", "current")
    )
    + f" FROM tel WINDOW w AS ({TEL_W})) SELECT {IDS}, "
    + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _CHANGE)
    + " FROM w",
)
def win_rate_of_change_and_gradient(spark, sf):
    def make(w):
        cols = {}
        for c in ("temperature", "pressure", "current"):
            cols[f"{c}_roc"] = feat.change_column(c, w)
            cols[f"{c}_grad"] = feat.gradient_column(c, w)
        return cols

    out = series_query(spark, sf, make, back=1, ahead=1)
    return out.select(*TEL_IDS, *[(F.round(c, 6) + 0.0).alias(c) for c in _CHANGE])


@query(
    "win_ewma",
    "WIN5",
    f"""WITH RECURSIVE {EVENTS_SQL},
    n AS (SELECT row_id, element_id, value, row_number() OVER ({EV_W}) AS rn FROM ev),
    e(element_id, rn, row_id, y) AS (
      SELECT element_id, rn, row_id, value FROM n WHERE rn = 1
      UNION ALL
      SELECT n.element_id, n.rn, n.row_id, (2.0::DOUBLE / 13.0) * n.value + (1.0 - 2.0::DOUBLE / 13.0) * e.y
      FROM e JOIN n ON n.element_id = e.element_id AND n.rn = e.rn + 1)
    SELECT row_id, round(y, 4) AS value_ewma FROM e""",
)
def win_ewma(spark, sf):
    def build(rows, keyed):
        return feat.add_ewma(rows, keyed, ["value"])

    out = over_series(events(spark, sf), EVENTS, build, back=feat.ewma_reach())
    return out.select("row_id", F.round("value_ewma", 4).alias("value_ewma"))


@query(
    "win_alarm_history",
    "WIN6 WIN7",
    f"""WITH {TELEMETRY_SQL}, n AS (SELECT *, row_number() OVER ({TEL_W}) AS rn FROM tel),
    l AS (SELECT *, max(CASE WHEN alarm = 1 THEN rn END) OVER ({TEL_W} ROWS UNBOUNDED PRECEDING) AS last_on,
                 avg(alarm) OVER ({TEL_W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS af FROM n)
    SELECT {IDS}, CAST(least(coalesce(rn - last_on, 10000), 10000) AS DOUBLE) AS time_since_alarm,
           round(af, 6) AS alarm_freq FROM l""",
)
def win_alarm_history(spark, sf):
    def make(w):
        return {
            "time_since_alarm": feat.since_alarm_column("alarm", w),
            "alarm_freq": feat.alarm_rate_column("alarm", w),
        }

    out = series_query(spark, sf, make, back=feat.ALARM_CAP)
    return out.select(*TEL_IDS, "time_since_alarm", F.round("alarm_freq", 6).alias("alarm_freq"))


@query(
    "win_rolling_correlation",
    "WIN8",
    f"""WITH {TELEMETRY_SQL}, m AS (
      SELECT {IDS}, count(*) OVER r AS n, avg(temperature) OVER r AS ma, avg(current) OVER r AS mb,
             avg(temperature * temperature) OVER r AS ma2, avg(current * current) OVER r AS mb2,
             avg(temperature * current) OVER r AS mab
      FROM tel WINDOW r AS ({TEL_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, (mab - ma * mb) / sqrt(greatest(ma2 - ma * ma, 1e-9) * greatest(mb2 - mb * mb, 1e-9)) AS r FROM m)
    SELECT {IDS}, round(CASE WHEN n >= 3 THEN greatest(least(r, 1.0), -1.0) ELSE 0 END, 6) + 0.0 AS temp_curr_corr
    FROM c""",
)
def win_rolling_correlation(spark, sf):
    out = series_query(
        spark, sf, lambda w: {"r": feat.rolling_correlation_column("temperature", "current", w)}, back=29
    )
    return out.select(*TEL_IDS, (F.round("r", 6) + 0.0).alias("temp_curr_corr"))


@query(
    "win_heartbeat_health_interactions",
    "WIN9 PRJ8 PRJ9 FUN1",
    f"""WITH {TELEMETRY_SQL}, d AS (
      SELECT *, heartbeat - lag(heartbeat) OVER ({TEL_W}) AS step FROM tel),
    h AS (SELECT *, CAST(coalesce(CASE WHEN step < 0 THEN step + 256 ELSE step END, 1) AS DOUBLE) AS heartbeat_delta FROM d)
    SELECT {IDS}, heartbeat_delta,
           round(greatest(least(1.0 - greatest(least(error_rate, 1.0), 0.0) - 0.3 * least(quality_flag, 2)
                 - CASE WHEN heartbeat_delta = 0 THEN 0.5 ELSE 0 END, 1.0), -2.0), 6) AS sensor_health,
           round(temperature * voltage, 6) AS temp_volt_interaction,
           round(pressure * temperature, 6) AS pres_temp_interaction
    FROM h""",
)
def win_heartbeat_health_interactions(spark, sf):
    out = series_query(spark, sf, lambda w: {"heartbeat_delta": feat.counter_delta_column("heartbeat", w)}, back=1)
    health = feat.health_column("error_rate", "quality_flag", F.col("heartbeat_delta"))
    return out.select(
        *TEL_IDS,
        "heartbeat_delta",
        F.round(health, 6).alias("sensor_health"),
        F.round(F.col("temperature") * F.col("voltage"), 6).alias("temp_volt_interaction"),
        F.round(F.col("pressure") * F.col("temperature"), 6).alias("pres_temp_interaction"),
    )


def all_features(spark, sf):
    return feat.add_features(telemetry(spark, sf), TELEMETRY)


_FULL_DIGITS = {
    **_ROLL,
    **{f"{c}_lag{n}": 6 for c in _LAGGED for n in (1, 5)},
    **_CHANGE,
    **{f"{c}_ewma": 3 for c in ("temperature", "current", "error_rate")},
    "time_since_alarm": 6,
    "alarm_freq": 6,
    "temp_curr_corr": 6,
    "heartbeat_delta": 6,
    "sensor_health": 6,
}
_KEEP = 1.0 - 2.0 / 13.0


@query(
    "features_all",
    "WIN1 WIN2 WIN3 WIN4 WIN5 WIN6 WIN7 WIN8 WIN9 PRJ8 PRJ9 PRJ10",
    f"""WITH {TELEMETRY_SQL}, n AS (SELECT *, row_number() OVER w AS rn, heartbeat - lag(heartbeat) OVER w AS step
      FROM tel WINDOW w AS ({TEL_W})),
    h AS (SELECT *, CAST(coalesce(CASE WHEN step < 0 THEN step + 256 ELSE step END, 1) AS DOUBLE) AS heartbeat_delta FROM n),
    w AS (SELECT *, """
    + ", ".join(
        f"avg({c}) OVER r15 AS {c}_roll_mean, coalesce(stddev_samp({c}) OVER r15, 0) AS {c}_roll_std, "
        f"median({c}) OVER r15 AS {c}_roll_median"
        for c in DYNAMIC
    )
    + ", "
    + ", ".join(f"coalesce(lag({c}, {n}) OVER w, 0) AS {c}_lag{n}" for c in _LAGGED for n in (1, 5))
    + ", "
    + ", ".join(
        f"""coalesce({c} - lag({c}) OVER w, 0) AS {c}_roc,
        CASE WHEN lag({c}) OVER w IS NULL AND lead({c}) OVER w IS NULL THEN 0
             WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c}
             WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w
             ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS {c}_grad"""
        for c in ("temperature", "pressure", "current")
    )
    + ", "
    + ", ".join(
        f"(2.0::DOUBLE / 13.0) * sum(CASE WHEN rn = 1 THEN {c} * 6.5 ELSE {c} END * pow({_KEEP!r}::DOUBLE, -rn)) "
        f"OVER (w ROWS UNBOUNDED PRECEDING) * pow({_KEEP!r}::DOUBLE, rn) AS {c}_ewma"
        for c in ("temperature", "current", "error_rate")
    )
    + """, CAST(least(coalesce(rn - max(CASE WHEN alarm = 1 THEN rn END) OVER (w ROWS UNBOUNDED PRECEDING), 10000), 10000)
           AS DOUBLE) AS time_since_alarm,
      avg(alarm) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS alarm_freq,
      count(*) OVER r30 AS n30, avg(temperature) OVER r30 AS ma, avg(current) OVER r30 AS mb,
      avg(temperature * temperature) OVER r30 AS ma2, avg(current * current) OVER r30 AS mb2,
      avg(temperature * current) OVER r30 AS mab """
    + f"""FROM h WINDOW w AS ({TEL_W}), r15 AS ({TEL_W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW),
          r30 AS ({TEL_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, CASE WHEN n30 >= 3 THEN greatest(least((mab - ma * mb) /
             sqrt(greatest(ma2 - ma * ma, 1e-9) * greatest(mb2 - mb * mb, 1e-9)), 1.0), -1.0) ELSE 0 END AS temp_curr_corr,
           greatest(least(1.0 - greatest(least(error_rate, 1.0), 0.0) - 0.3 * least(quality_flag, 2)
                 - CASE WHEN heartbeat_delta = 0 THEN 0.5 ELSE 0 END, 1.0), -2.0) AS sensor_health FROM w)
    SELECT {IDS}, """
    + ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in _FULL_DIGITS.items())
    + " FROM c",
)
def features_all(spark, sf):
    out = all_features(spark, sf)
    return out.select(*TEL_IDS, *[(F.round(c, d) + 0.0).alias(c) for c, d in _FULL_DIGITS.items()])


@query(
    "prj_feature_columns",
    "PRJ1 PRJ10",
    f"""WITH {TELEMETRY_SQL}, one AS (SELECT count(*) AS n_rows FROM tel)
    SELECT n_rows, u.is_feature, u.is_engineered, u.n_columns FROM one, (VALUES
      (CAST(1 AS INTEGER), CAST(1 AS INTEGER), CAST(35 AS BIGINT)), (1, 0, 9), (0, 1, 2), (0, 0, 7))
      AS u(is_feature, is_engineered, n_columns)""",
)
def prj_feature_columns(spark, sf):
    df = all_features(spark, sf)
    model, made = set(feat.feature_columns(df)), set(feat.engineered_columns(df))
    sizes: dict[tuple[int, int], int] = {}
    for c in df.columns:
        key = (int(c in model), int(c in made))
        sizes[key] = sizes.get(key, 0) + 1
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("is_feature"), F.lit(b).alias("is_engineered"), F.lit(n).cast("long").alias("n_columns")
            )
            for (a, b), n in sorted(sizes.items())
        ]
    )
    counted = telemetry(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select("n_rows", F.explode(entries).alias("e")).select("n_rows", "e.*")


_CHANNELS = ["temperature", "pressure", "voltage", "current"]


def _zscore_sql(sd: str) -> str:
    return (
        f"WITH {TELEMETRY_SQL}, p AS (SELECT *, row_number() OVER ({TEL_W}) AS rn, "
        "count(*) OVER (PARTITION BY element_id) AS n FROM tel), s AS (SELECT "
        + ", ".join(f"avg({c}) AS {c}_mu, {sd}({c}) AS {c}_sd" for c in _CHANNELS)
        + f" FROM p WHERE rn <= floor(n * 0.6)) SELECT {IDS}, "
        + ", ".join(
            f"round((coalesce({c}, 0) - {c}_mu) / CASE WHEN {c}_sd = 0 THEN 1 ELSE {c}_sd END, 6) + 0.0 AS {c}"
            for c in _CHANNELS
        )
        + " FROM p, s"
    )


def _zscore(spark, sf, ddof):
    split = temporal_split(telemetry(spark, sf), TELEMETRY, 0.6)
    scaler = fit_scaler(split.filter("is_train = 1"), _CHANNELS, ddof)
    out = apply_scaler(split, scaler, _CHANNELS)
    return out.select(*TEL_IDS, *[(F.round(c, 6) + 0.0).alias(c) for c in _CHANNELS])


@query("prj_zscore_population", "PRJ2 PRJ3", _zscore_sql("stddev_pop"))
def prj_zscore_population(spark, sf):
    return _zscore(spark, sf, 0)


@query("prj_zscore_sample", "PRJ4", _zscore_sql("stddev_samp"))
def prj_zscore_sample(spark, sf):
    return _zscore(spark, sf, 1)


@query(
    "prj_feature_matrix",
    "PRJ2",
    f"""WITH {TELEMETRY_SQL} SELECT {IDS}, 4 AS n_values,
    round(temperature + pressure + voltage + current, 4) AS total FROM tel""",
)
def prj_feature_matrix(spark, sf):
    df = feat.feature_array(telemetry(spark, sf), _CHANNELS)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return df.select(*TEL_IDS, F.size("features").alias("n_values"), F.round(total, 4).alias("total"))


@query(
    "prj_drop_labels",
    "PRJ11 SRC4",
    f"WITH {TELEMETRY_SQL} SELECT * EXCLUDE (anomaly, anomaly_type) FROM tel",
)
def prj_drop_labels(spark, sf):
    return feat.drop_labels(telemetry(spark, sf))


@query(
    "win_temporal_split",
    "WIN10",
    f"""WITH {EVENTS_SQL}, p AS (SELECT *, row_number() OVER ({EV_W}) AS rn,
      count(*) OVER (PARTITION BY element_id) AS n FROM ev)
    SELECT row_id, CASE WHEN rn <= floor(n * 0.6) THEN 1 ELSE 0 END AS is_train FROM p""",
)
def win_temporal_split(spark, sf):
    return temporal_split(events(spark, sf), EVENTS, 0.6).select("row_id", "is_train")


_SEGMENT_SQL = f""",
marked AS (SELECT *, row_number() OVER ({EV_W}) AS rn,
  CASE WHEN label = 1 AND coalesce(lag(label) OVER ({EV_W}), 0) <> 1 THEN 1 ELSE 0 END AS st FROM scored),
seg AS (SELECT *, sum(st) OVER ({EV_W} ROWS UNBOUNDED PRECEDING) AS sid FROM marked)
"""


@query(
    "win_segments",
    "WIN11",
    f"""WITH {SCORED_SQL} {_SEGMENT_SQL}
    SELECT element_id, CAST(sid AS BIGINT) AS segment, CAST(min(rn) - 1 AS BIGINT) AS "start",
           CAST(max(rn) AS BIGINT) AS "end", count(*) AS n_rows FROM seg WHERE label = 1 GROUP BY element_id, sid""",
)
def win_segments(spark, sf):
    return segment_table(events(spark, sf).withColumnRenamed("anomaly", "label"), EVENTS)


@query(
    "win_time_bucket",
    "WIN12",
    f"WITH {TELEMETRY_SQL} SELECT {IDS}, CAST((row_number() OVER ({TEL_W}) - 1) // 500 AS BIGINT) AS bucket FROM tel",
)
def win_time_bucket(spark, sf):
    return time_bucket(telemetry(spark, sf), TELEMETRY, 500).select(*TEL_IDS, "bucket")


@query(
    "win_point_adjust",
    "WIN13 PRJ6",
    f"""WITH {SCORED_SQL} {_SEGMENT_SQL},
    p AS (SELECT *, CASE WHEN score >= 2.0 THEN 1 ELSE 0 END AS predicted FROM seg)
    SELECT row_id, predicted, CASE WHEN label = 1 THEN max(predicted) OVER (PARTITION BY element_id, label, sid)
           ELSE predicted END AS adjusted FROM p""",
)
def win_point_adjust(spark, sf):
    df = scored(spark, sf).withColumn("predicted", (F.col("score") >= 2.0).cast("int"))
    return point_adjust(df, EVENTS).select("row_id", "predicted", "adjusted")


_WINDOW_LISTS = f"""
win AS (SELECT row_id, element_id, anomaly, row_number() OVER ({EV_W}) AS rn,
  list(value) OVER ({EV_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS vs,
  list(k) OVER ({EV_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ks FROM ev)
"""


def _window_rows(df):
    v = F.transform("win", lambda s: s[0])
    k = F.transform("win", lambda s: s[1])
    return df.select(
        "row_id",
        "element_id",
        "anomaly",
        F.size("win").alias("n_steps"),
        F.get(v, F.lit(0)).alias("first_value"),
        F.element_at(v, -1).alias("last_value"),
        F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("sum_value"),
        F.round(F.aggregate(k, F.lit(0.0), lambda a, x: a + x), 4).alias("sum_k"),
    )


_WINDOW_OUT = """SELECT row_id, element_id, anomaly, CAST(len(vs) AS INTEGER) AS n_steps, vs[1] AS first_value,
  vs[-1] AS last_value, round(list_sum(vs), 4) AS sum_value, round(list_sum(ks), 4) AS sum_k FROM win"""


@query(
    "win_sliding_windows",
    "WIN14",
    f"WITH {EVENTS_SQL}, {_WINDOW_LISTS} {_WINDOW_OUT} WHERE rn >= 10 AND (rn - 10) % 3 = 0",
)
def win_sliding_windows(spark, sf):
    return _window_rows(sliding_windows(events(spark, sf), EVENTS, ["value", "k"], 10, 3, label="anomaly"))


@query(
    "win_stride_subset",
    "WIN15",
    f"WITH {EVENTS_SQL}, {_WINDOW_LISTS} {_WINDOW_OUT} WHERE rn >= 10 AND (rn - 10) % 4 = 0",
)
def win_stride_subset(spark, sf):
    dense = sliding_windows(events(spark, sf), EVENTS, ["value", "k"], 10, 1, label="anomaly")
    return _window_rows(stride_subset(dense, 4))


def _window_scores(spark, sf):
    """Mean of the window as a score."""
    w = sliding_windows(events(spark, sf), EVENTS, ["value"], 10)
    mean = F.aggregate("win", F.lit(0.0), lambda a, x: a + x[0]) / F.size("win")
    return w.select("row_id", F.round(mean, 6).alias("score"))


_WINDOW_SCORE_SQL = f"""
ws AS (SELECT row_id, element_id, rn, round(m, 6) AS score FROM (
  SELECT row_id, element_id, row_number() OVER ({EV_W}) AS rn,
         avg(value) OVER ({EV_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM ev) WHERE rn >= 10)
"""


@query(
    "win_scores_to_rows",
    "WIN16 AGG14",
    f"""WITH {EVENTS_SQL}, {_WINDOW_SCORE_SQL}, f AS (SELECT quantile_cont(score, 0.01) AS fill FROM ws)
    SELECT ev.row_id, round(coalesce(ws.score, f.fill), 6) AS score
    FROM ev LEFT JOIN ws ON ws.row_id = ev.row_id, f""",
)
def win_scores_to_rows(spark, sf):
    rows = events(spark, sf).select("row_id")
    out = scores_to_rows(rows, _window_scores(spark, sf), ["row_id"])
    return out.select("row_id", F.round("score", 6).alias("score"))


@query(
    "win_align_scores",
    "WIN17",
    f"""WITH {EVENTS_SQL}, {_WINDOW_SCORE_SQL}, f AS (SELECT element_id, score AS head FROM ws WHERE rn = 10)
    SELECT ev.row_id, coalesce(ws.score, f.head) AS score
    FROM ev LEFT JOIN ws ON ws.row_id = ev.row_id LEFT JOIN f ON f.element_id = ev.element_id""",
)
def win_align_scores(spark, sf):
    rows = events(spark, sf).select("row_id", "element_id", "ts")
    return align_scores(rows, _window_scores(spark, sf), EVENTS).select("row_id", "score")


@query(
    "win_stable_row_id",
    "WIN18",
    f"""WITH {EVENTS_SQL} SELECT row_id, CAST(row_number() OVER (ORDER BY element_id, ts, row_id) - 1 AS BIGINT)
    AS stable_id FROM ev""",
)
def win_stable_row_id(spark, sf):
    return stable_row_id(events(spark, sf), EVENTS, "stable_id").select("row_id", "stable_id")

