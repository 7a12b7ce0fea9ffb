"""Queries that run as streams over the event table, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.artifacts import load_artifact, save_artifact
from tidemark.functions.scaling import Standard
from tidemark.operators.windows import temporal_split
from tidemark.plans.stages import work_folder
from tidemark.streaming.deadband import fill_grid
from tidemark.streaming.features import causal_features, score_rows_stream, score_windows_stream, timed
from tidemark.streaming.spot import calibrate, spot_batch, spot_stream
from workload.catalog import query
from workload.roles import EV_W, EVENTS, EVENTS_SQL, LAB, events, read


def event_stream(spark, sf):
    """The event file as a stream, with the columns that the operators need."""
    schema = read(spark, sf, "events").schema
    raw = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf)
    )
    return raw.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("element_id"),
        F.col("event_type").alias("subsystem"),
        "ts",
        "value",
    )


def finished(spark, stream, name):
    """Run a stream over all available input into a table and read that."""
    folder = work_folder(spark, name)
    started = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _calibration(spark, sf):
    split = temporal_split(events(spark, sf).select("row_id", "subsystem", "ts", "value"), LAB, 0.6)
    start = calibrate(split.filter("is_train = 1"), ["subsystem"], "value")
    return start, split.filter("is_train = 0").drop("is_train")


def _level(n, c, s, q):
    """The threshold from the level u, the rows n and the moments of the excesses, in SQL."""
    mean, var = f"({s} / {c})", f"(({q} - {s} * {s} / {c}) / ({c} - 1))"
    ratio = f"(CASE WHEN {var} > 0 THEN {mean} * {mean} / {var} ELSE 1 END)"
    xi, sigma = f"(0.5 * (1 - {ratio}))", f"(0.5 * {mean} * (1 + {ratio}))"
    return (
        f"CASE WHEN abs({xi}) < 1e-6 THEN u + {sigma} * ln({c} / (1e-3 * {n}))"
        f" ELSE u + {sigma} / {xi} * (pow(1e-3 * {n} / {c}, -{xi}) - 1) END"
    )


# The walk over the rows above u, one after another; a row is counted, or joins the excesses, unless it is an alarm.
_SPOT_SQL = f"""WITH RECURSIVE {EVENTS_SQL},
pos AS (SELECT row_id, subsystem, ts, value, row_number() OVER w AS rn, count(*) OVER (PARTITION BY subsystem) AS of
        FROM ev WINDOW w AS (PARTITION BY subsystem ORDER BY ts, row_id)),
cal AS (SELECT subsystem, value FROM pos WHERE rn <= floor(of * 0.6)),
levels AS (SELECT subsystem, quantile_cont(value, 0.98) AS u, count(*)::DOUBLE AS n FROM cal GROUP BY ALL),
start AS (SELECT subsystem, u, n, count(*)::DOUBLE AS c, sum(value - u) AS s, sum((value - u) * (value - u)) AS q
          FROM cal JOIN levels USING (subsystem) WHERE value > u GROUP BY ALL),
later AS (SELECT subsystem, row_id, value, u, p, count(*) FILTER (value > u) OVER (PARTITION BY subsystem ORDER BY p) AS k FROM (
            SELECT subsystem, row_id, value, row_number() OVER (PARTITION BY subsystem ORDER BY rn) AS p FROM pos WHERE rn > floor(of * 0.6)
          ) JOIN levels USING (subsystem)),
walk AS (
  SELECT subsystem, 0::BIGINT AS k, 0::BIGINT AS p, u, n, c, s, q, {_level("n", "c", "s", "q")} AS zq, NULL::DOUBLE AS before, 0 AS alarm FROM start
  UNION ALL
  SELECT subsystem, k, p, u, n, c, s, q, CASE WHEN alarm = 1 THEN before ELSE {_level("n", "c", "s", "q")} END AS zq, before, alarm FROM (
    SELECT w.subsystem, t.k, t.p, w.u, w.n + (t.p - w.p - 1) + CASE WHEN t.value > w.zq THEN 0 ELSE 1 END AS n,
           w.c + CASE WHEN t.value > w.zq THEN 0 ELSE 1 END AS c,
           w.s + CASE WHEN t.value > w.zq THEN 0 ELSE t.value - w.u END AS s,
           w.q + CASE WHEN t.value > w.zq THEN 0 ELSE (t.value - w.u) * (t.value - w.u) END AS q,
           w.zq AS before, CASE WHEN t.value > w.zq THEN 1 ELSE 0 END AS alarm
    FROM walk w JOIN later t ON t.subsystem = w.subsystem AND t.k = w.k + 1 AND t.value > t.u
  )
)
SELECT subsystem, row_id, round(CASE WHEN value > l.u THEN before ELSE zq END, 6) AS threshold,
       CASE WHEN value > l.u THEN alarm ELSE 0 END AS alarm
FROM later l JOIN walk USING (subsystem, k)"""


@query("stream_spot_batch", "STR1 DET14", _SPOT_SQL)
def stream_spot_batch(spark, sf):
    start, rows = _calibration(spark, sf)
    out = spot_batch(rows, LAB, start, "value")
    return out.select("subsystem", "row_id", F.round("threshold", 6).alias("threshold"), "alarm")


@query("stream_spot", "STR1", _SPOT_SQL)
def stream_spot(spark, sf):
    start, rows = _calibration(spark, sf)
    # the rows after those that the state was calibrated on, as in the batch form
    later = event_stream(spark, sf).join(rows.select("row_id"), "row_id", "left_semi")
    stream = timed(later, "ts", "1 hour")
    out = spot_stream(stream, ["subsystem"], ["ts", "row_id"], ["row_id"], start, "value")
    return finished(spark, out, "spot").withColumn("threshold", F.round("threshold", 6))


@query(
    "stream_window_scores",
    "STR2 DET20",
    f"""WITH {EVENTS_SQL}, w AS (SELECT element_id, row_id, row_number() OVER ({EV_W}) AS rn,
      avg(value) OVER ({EV_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM ev)
    SELECT element_id, row_id, round(m, 5) AS score FROM w WHERE rn >= 10""",
)
def stream_window_scores(spark, sf):
    stream = score_windows_stream(
        event_stream(spark, sf), ["element_id"], ["ts", "row_id"], ["row_id"], ["value"], 10, lambda x: x.mean(axis=(1, 2))
    )
    out = finished(spark, stream, "windows")
    return out.select("element_id", "row_id", F.round("score", 5).alias("score"))


@query(
    "stream_row_scores",
    "STR2",
    f"""WITH {EVENTS_SQL}, f AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM ev)
    SELECT row_id, round(abs((value - m) / d), 5) AS score FROM ev, f""",
)
def stream_row_scores(spark, sf):
    folder = work_folder(spark, "scaler")
    save_artifact(spark, folder, 1, scaler=Standard.of(events(spark, sf), ["value"]))
    frozen = load_artifact(spark, folder, 1, scaler=Standard)["scaler"]
    score = lambda df: frozen.apply(df, ["value"]).select("row_id", F.abs("value").alias("score"))
    out = finished(spark, score_rows_stream(event_stream(spark, sf), score), "rows")
    return out.select("row_id", F.round("score", 5).alias("score"))


_CAUSAL = {
    "value_roll_mean": 5, "value_roll_std": 4, "value_roll_median": 5, "value_lag1": 5, "value_lag5": 5, "value_roc": 5,
    "value_ewma": 4,
}


@query(
    "stream_causal_features",
    "STR3 WIN1 WIN2 WIN3",
    f"""WITH RECURSIVE {EVENTS_SQL},
    n AS (SELECT element_id, row_id, value, row_number() OVER ({EV_W}) AS rn FROM ev),
    y AS (SELECT element_id, row_id, rn, value AS value_ewma FROM n WHERE rn = 1 UNION ALL
      SELECT n.element_id, n.row_id, n.rn, (2.0::DOUBLE / 13.0) * n.value + (1.0 - 2.0::DOUBLE / 13.0) * y.value_ewma
      FROM y JOIN n ON n.element_id = y.element_id AND n.rn = y.rn + 1),
    w AS (SELECT element_id, row_id, avg(value) OVER r AS value_roll_mean,
      coalesce(stddev_samp(value) OVER r, 0) AS value_roll_std, median(value) OVER r AS value_roll_median,
      coalesce(lag(value) OVER w, 0) AS value_lag1, coalesce(lag(value, 5) OVER w, 0) AS value_lag5,
      coalesce(value - lag(value) OVER w, 0) AS value_roc
      FROM ev WINDOW w AS ({EV_W}), r AS ({EV_W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))
    SELECT element_id, row_id, {', '.join(f'round({c}, {d}) + 0.0 AS {c}' for c, d in _CAUSAL.items())}
    FROM w JOIN y USING (element_id, row_id)""",
)
def stream_causal_features(spark, sf):
    stream = causal_features(event_stream(spark, sf), ["element_id"], ["ts", "row_id"], ["row_id"], "value")
    out = finished(spark, stream, "causal")
    return out.select("element_id", "row_id", *[(F.round(c, d) + 0.0).alias(c) for c, d in _CAUSAL.items()])


@query(
    "stream_deadband_fill",
    "STR4",
    f"""WITH {EVENTS_SQL}, n AS (SELECT *, lead(ts) OVER ({EV_W}) AS nx FROM ev),
    b AS (SELECT *, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS f,
             coalesce(CAST(ceil(epoch_us(nx) / 3600000000.0) AS BIGINT) - 1, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT)) AS l FROM n)
    SELECT element_id, value, k, unnest(range(f, l + 1)) AS slot FROM b WHERE l >= f""",
)
def stream_deadband_fill(spark, sf):
    out = fill_grid(events(spark, sf).select("row_id", "element_id", "ts", "value", "k"), EVENTS, ["value", "k"], 3600)
    return out.select("element_id", "value", "k", (F.unix_seconds("grid_time") / 3600).cast("long").alias("slot"))
