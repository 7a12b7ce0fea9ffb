"""Queries over sources, sinks, spec joins and fault injection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import augment as aug
from tidemark.operators.evaluation import compute_metrics
from tidemark.operators.windows import temporal_split
from tidemark.plans.ordered import with_position
from tidemark.plans.stages import work_folder
from tidemark.sources import results as res
from tidemark.sources import telemetry as tel
from workload.catalog import query
from workload.evaluation import _FULL_SQL
from workload.roles import (
    EV_W,
    EVENTS,
    EVENTS_SQL,
    MODEL_SCORES_SQL,
    MODELS,
    TEL_IDS,
    TEL_W,
    TELEMETRY,
    TELEMETRY_SQL,
    events,
    model_scores,
    predictions,
    telemetry,
)

IDS = ", ".join(TEL_IDS)


def _labeled_events(spark, sf):
    """events under the column names of the labeled telemetry schema."""
    return events(spark, sf).select(
        "row_id", F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("element_id").cast("string").alias("element_id"), "subsystem",
        F.col("value").alias("temperature"), "alarm", "anomaly", "anomaly_type",
    )


@query(
    "source_load_labeled",
    "SRC1 SRC4",
    f"""WITH {EVENTS_SQL} SELECT row_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS read_at, CAST(element_id AS VARCHAR) AS element_id,
    subsystem, value AS temperature, alarm, anomaly, anomaly_type FROM ev""",
)
def source_load_labeled(spark, sf):
    folder = work_folder(spark, "views")
    tel.write_views(_labeled_events(spark, sf), folder)
    cols = ["row_id", "element_id", "subsystem", "temperature", "alarm", "anomaly", "anomaly_type"]
    read_at = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("read_at")
    return tel.load_labeled(spark, f"{folder}/labeled").select(*cols, read_at)


@query(
    "source_load_unlabeled_with_truth",
    "SRC1 SRC2 SRC4 JOI1",
    f"WITH {EVENTS_SQL} SELECT row_id, value AS temperature, alarm, anomaly, anomaly_type FROM ev",
)
def source_load_unlabeled_with_truth(spark, sf):
    folder = work_folder(spark, "views")
    tel.write_views(_labeled_events(spark, sf), folder, "csv")
    plain = tel.load_unlabeled(spark, f"{folder}/unlabeled", "csv")
    truth = tel.load_ground_truth(spark, f"{folder}/ground_truth", "csv")
    out = tel.attach_ground_truth(plain, truth)
    return out.select("row_id", "temperature", "alarm", "anomaly", "anomaly_type")


@query(
    "source_load_pair",
    "SRC3 WIN10",
    f"""WITH {EVENTS_SQL}, p AS (SELECT *, row_number() OVER ({EV_W}) AS rn, count(*) OVER (PARTITION BY element_id) AS n FROM ev)
    SELECT CASE WHEN rn <= floor(n * 0.6) THEN 'train' ELSE 'test' END AS part, row_id, value FROM p""",
)
def source_load_pair(spark, sf):
    folder = work_folder(spark, "pair")
    split = temporal_split(events(spark, sf).select("row_id", "element_id", "ts", "value", "anomaly"), EVENTS, 0.6)
    split.filter("is_train = 1").drop("is_train", "anomaly").write.parquet(f"{folder}/train")
    split.filter("is_train = 0").drop("is_train").write.parquet(f"{folder}/test")
    train, test, _ = tel.load_pair(spark, f"{folder}/train", f"{folder}/test")
    cols = ["row_id", "value"]
    return train.select(F.lit("train").alias("part"), *cols).unionByName(test.select(F.lit("test").alias("part"), *cols))


@query(
    "sink_predictions",
    "SRC5 SRC7 JOI2",
    f"""WITH {MODEL_SCORES_SQL} SELECT model, row_id, element_id, subsystem, label AS anomaly, score AS anomaly_score, predicted FROM preds""",
)
def sink_predictions(spark, sf):
    folder = work_folder(spark, "predictions")
    res.save_predictions(res.prediction_table(predictions(spark, sf).withColumnRenamed("label", "anomaly")), folder)
    return res.load_predictions(
        spark, folder, ["model", "row_id", "element_id", "subsystem", "anomaly", "anomaly_score", "predicted"]
    )


def _records(spark, sf):
    record = compute_metrics(model_scores(spark, sf), EVENTS, ["model"])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return record.withColumns(
        {"family": F.lit("rule"), "train_time_s": F.lit(0.0), "predict_time_s": F.lit(0.25), "n_scored": n}
    )


_RECORD_SQL = _FULL_SQL.replace("SELECT model, threshold, round((tp + tn)", "SELECT model, threshold, tp + fp + fn + tn AS n_scored, round((tp + tn)")


@query(
    "sink_metrics_latest",
    "SRC6 FUN9",
    f"""WITH r AS ({_RECORD_SQL}) SELECT model, round(threshold, 4) AS threshold, round(f1, 4) AS f1, round(pa_f1, 4) AS pa_f1, tp, fp, fn, tn FROM r""",
)
def sink_metrics_latest(spark, sf):
    folder = work_folder(spark, "metrics")
    records = _records(spark, sf)
    rounded = records.withColumns({c: F.round(c, 6) for c in ("f1", "pa_f1")})
    stale = rounded.withColumns({"f1": F.lit(0.0), "tp": F.lit(0).cast("long")})
    res.save_metrics(stale, folder, 1)
    res.save_metrics(rounded, folder, 2)
    return res.load_metrics(spark, folder).select("model", "threshold", "f1", "pa_f1", "tp", "fp", "fn", "tn")


@query(
    "source_leaderboard",
    "SRC8 AGG19 FUN3",
    f"""WITH r AS ({_RECORD_SQL}) SELECT model, 'rule' AS family, round(n_scored / 0.25) AS rows_per_s, round(f1, 4) AS f1,
    round(roc_auc, 4) AS roc_auc, fp, fn, CASE model WHEN 'roll_dev' THEN 0 WHEN 'level' THEN 1 WHEN 'jump' THEN 2 ELSE 999 END AS ord FROM r""",
)
def source_leaderboard(spark, sf):
    folder = work_folder(spark, "records")
    records = _records(spark, sf).withColumns({c: F.round(c, 6) for c in ("f1", "roc_auc")}).persist()
    for m in MODELS:
        records.filter(F.col("model") == m).drop("model").coalesce(1).write.json(f"{folder}/{m}_metrics.json")
    records.unpersist()
    registry = spark.createDataFrame([("roll_dev", 0), ("level", 1), ("jump", 2)], "model string, ord int")
    out = res.leaderboard(res.gather_metrics(spark, f"{folder}/*_metrics.json"), registry)
    return out.select("model", "family", "rows_per_s", "f1", "roc_auc", "fp", "fn", "ord")


@query(
    "fun_metrics_json",
    "FUN9",
    f"""WITH {EVENTS_SQL}, c AS (SELECT element_id, count(*) AS n, sum(anomaly)::DOUBLE AS p FROM ev GROUP BY element_id)
    SELECT element_id, n, round(p / n, 6) AS rate FROM c""",
)
def fun_metrics_json(spark, sf):
    per = events(spark, sf).groupBy("element_id").agg(
        F.count(F.lit(1)).alias("n"), F.create_map(F.lit("rate"), F.avg(F.col("anomaly").cast("double"))).alias("per_fault")
    )
    text = per.select("element_id", F.to_json(F.struct("n", "per_fault")).alias("j"))
    back = text.withColumn("r", F.from_json("j", "n long, per_fault map<string,double>"))
    return back.select("element_id", "r.n", F.round(F.col("r.per_fault")["rate"], 6).alias("rate"))


@query(
    "fun_timestamp_and_names",
    "FUN2 FUN3",
    f"""WITH {EVENTS_SQL} SELECT row_id, strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(row_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS at,
    subsystem || '_' || lpad(CAST(element_id % 100 AS VARCHAR), 2, '0') AS name,
    len(string_split(subsystem || ',' || CAST(element_id AS VARCHAR), ',')) AS n_parts FROM ev""",
)
def fun_timestamp_and_names(spark, sf):
    at = tel.minute_timestamp("2026-01-01 00:00:00", F.col("row_id").cast("int"))
    parts = F.size(F.split(F.concat_ws(",", "subsystem", F.col("element_id").cast("string")), ","))
    return events(spark, sf).select(
        "row_id",
        F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"),
        tel.element_name(F.col("subsystem"), F.col("element_id") % 100).alias("name"),
        parts.cast("long").alias("n_parts"),
    )


# ---------------------------------------------------------------- spec join and rule alarm


@query(
    "join_spec_rule_alarm",
    "JOI5 PRJ5",
    f"""WITH {TELEMETRY_SQL}, s AS (SELECT subsystem, round(avg(temperature), 6) AS tm, round(1.5 * stddev_pop(temperature), 6) AS tb,
      round(avg(voltage), 6) AS vm, round(1.5 * stddev_pop(voltage), 6) AS vb FROM tel GROUP BY subsystem)
    SELECT {IDS}, CASE WHEN abs(temperature - tm) > tb OR abs(voltage - vm) > vb OR error_rate > 0.15 OR quality_flag >= 2
      THEN 1 ELSE 0 END AS rule_alarm FROM tel JOIN s USING (subsystem)""",
)
def join_spec_rule_alarm(spark, sf):
    df = telemetry(spark, sf)
    spec = df.groupBy("subsystem").agg(
        F.round(F.avg("temperature"), 6).alias("temp_mean"),
        F.round(1.5 * F.stddev_pop("temperature"), 6).alias("temp_band"),
        F.round(F.avg("voltage"), 6).alias("voltage_mean"),
        F.round(1.5 * F.stddev_pop("voltage"), 6).alias("voltage_band"),
    )
    return aug.rule_alarm(df, spec).select(*TEL_IDS, "rule_alarm")


# ---------------------------------------------------------------- fault injection

LENGTH = 120


def _episodes(df):
    """One episode of a kind per series (kinds take turns) and a second that overlaps its end."""
    key = F.col("element_id")
    kinds = F.array(*[F.lit(k) for k in aug.KINDS])
    per = df.select("element_id").distinct()
    channel = F.when(key % 2 == 0, "current").otherwise("pressure")
    first = per.select(
        "element_id",
        F.lit(1).alias("episode"),
        F.get(kinds, (key % len(aug.KINDS)).cast("int")).alias("kind"),
        channel.alias("channel"),
        (30 + key % 50).alias("start"),
        (30 + key % 50 + LENGTH).alias("end"),
        (1.0 + (key % 7) / 4.0).alias("size"),
    )
    second = per.select(
        "element_id",
        F.lit(2).alias("episode"),
        F.lit("temperature_drift").alias("kind"),
        channel.alias("channel"),
        (30 + key % 50 + LENGTH - 20).alias("start"),
        (30 + key % 50 + LENGTH + 60).alias("end"),
        F.lit(5.0).alias("size"),
    )
    return first.unionByName(second)


_KIND_LIST = "[" + ", ".join(f"'{k}'" for k in aug.KINDS) + "]"


def _inject_sql(period: float, lag: int, ct: float, cc: float, tail: int, sag: float, amp: float, phase: float) -> str:
    return f"""WITH {TELEMETRY_SQL}, x AS (SELECT *, row_number() OVER ({TEL_W}) - 1 AS step FROM tel),
    ep AS (SELECT element_id, 1 AS no, {_KIND_LIST}[element_id % 11 + 1] AS kind, CASE WHEN element_id % 2 = 0 THEN 'current' ELSE 'pressure' END AS ch,
             30 + element_id % 50 AS s, 30 + element_id % 50 + {LENGTH} AS e, 1.0::DOUBLE + (element_id % 7) / 4.0 AS size FROM (SELECT DISTINCT element_id FROM tel)
           UNION ALL SELECT element_id, 2, 'temperature_drift', CASE WHEN element_id % 2 = 0 THEN 'current' ELSE 'pressure' END,
             30 + element_id % 50 + {LENGTH - 20}, 30 + element_id % 50 + {LENGTH + 60}, 5.0 FROM (SELECT DISTINCT element_id FROM tel)),
    j AS (SELECT x.*, ep.kind, ep.no, ep.size, ep.ch, ep.s, ep.e, (step - s)::DOUBLE AS p, (e - s)::DOUBLE AS m FROM x JOIN ep
          ON ep.element_id = x.element_id AND step >= s AND step < e),
    d AS (SELECT {IDS}, ts, temperature AS t0, current AS c0,
      sum(CASE kind WHEN 'temperature_drift' THEN size * p / (m - 1) WHEN 'contextual_anomaly'
            THEN {amp} * (sin(2 * pi() * step / 1440 + {phase} + pi()) - sin(2 * pi() * step / 1440 + {phase}))
            WHEN 'cooling_failure' THEN size * pow(p / (m - 1), 1.3) WHEN 'cascading_failure' THEN {ct} * pow(p / (m - 1), 1.5)
            ELSE 0 END) AS dt,
      sum(CASE kind WHEN 'temperature_drift' THEN 1.5 * size * p / (m - 1) WHEN 'collective_anomaly' THEN size * sin(2 * pi() * p / {period})
            WHEN 'cooling_failure' THEN 12.0 * pow(p / (m - 1), 1.3)
            WHEN 'cascading_failure' THEN CASE WHEN p >= {lag} THEN {cc} * pow((p - {lag}) / (m - 1), 1.5) ELSE 0 END
            WHEN 'point_anomaly' THEN CASE WHEN ch = 'current' THEN 20.0 * size ELSE 0 END
            WHEN 'persistent_anomaly' THEN CASE WHEN ch = 'current' THEN 8.0 * size ELSE 0 END ELSE 0 END) AS dc,
      sum(CASE kind WHEN 'cooling_failure' THEN 0.15 * pow(p / (m - 1), 1.3)
            WHEN 'point_anomaly' THEN CASE WHEN ch = 'pressure' THEN 0.3 * size ELSE 0 END
            WHEN 'persistent_anomaly' THEN CASE WHEN ch = 'pressure' THEN 0.08 * size ELSE 0 END ELSE 0 END) AS dp,
      sum(CASE kind WHEN 'voltage_spike' THEN size WHEN 'cascading_failure'
            THEN CASE WHEN p >= m - {tail} THEN -{sag} * (p - (m - {tail})) / ({tail} - 1) ELSE 0 END ELSE 0 END) AS dv,
      sum(CASE kind WHEN 'increasing_error_rate' THEN size * p / (m - 1) WHEN 'communication_loss' THEN 0.2 ELSE 0 END) AS de,
      max(CASE WHEN kind = 'communication_loss' THEN 2 WHEN kind = 'sensor_freeze' THEN 1
            WHEN kind = 'cooling_failure' AND pow(p / (m - 1), 1.3) > 0.6 THEN 1
            WHEN kind = 'cascading_failure' AND pow(p / (m - 1), 1.5) > 0.5 THEN 1
            WHEN kind = 'increasing_error_rate' AND error_rate + size * p / (m - 1) > 0.3 THEN 1 ELSE 0 END) AS q,
      max(CASE WHEN kind IN ('sensor_freeze', 'communication_loss') THEN s END) AS hold,
      max(CASE WHEN kind = 'communication_loss' THEN s END) AS frozen, arg_max(kind, no) AS kind
      FROM j GROUP BY {IDS}, ts, temperature, current),
    r AS (SELECT x.*, d.dt, d.dc, d.dp, d.dv, d.de, d.q, d.kind, d.hold, d.frozen, h.temperature AS ht, h.pressure AS hp, h.voltage AS hv,
            h.current AS hc, h.heartbeat AS hh
      FROM x LEFT JOIN d ON d.element_id = x.element_id AND d.ts = x.ts AND d.orderkey = x.orderkey AND d.linenumber = x.linenumber
        AND d.partkey = x.partkey AND d.t0 = x.temperature AND d.c0 = x.current
      LEFT JOIN x h ON h.element_id = x.element_id AND h.step = d.hold - 1)
    SELECT {IDS}, round(coalesce(ht, temperature) + coalesce(dt, 0), 5) AS temperature,
      round(coalesce(hp, pressure) + coalesce(dp, 0), 5) AS pressure, round(coalesce(hv, voltage) + coalesce(dv, 0), 5) AS voltage,
      round(coalesce(hc, current) + coalesce(dc, 0), 4) AS current, round(error_rate + coalesce(de, 0), 5) AS error_rate,
      greatest(quality_flag, coalesce(q, 0)) AS quality_flag, CASE WHEN frozen IS NOT NULL THEN hh ELSE heartbeat END AS heartbeat,
      CASE WHEN kind IS NOT NULL THEN 1 ELSE anomaly END AS anomaly, coalesce(kind, anomaly_type) AS anomaly_type FROM r"""


def _injected(spark, sf, values):
    # A float identity for rows whose order keys repeat.
    df = telemetry(spark, sf)
    placed = with_position(df, TELEMETRY, "pos").withColumn("step", F.col("pos") - 1).drop("pos")
    row = ["element_id", "step"]
    out = aug.inject(placed, _episodes(df), ["element_id"], "step", row, values)
    digits = {"temperature": 5, "pressure": 5, "voltage": 5, "current": 4, "error_rate": 5}
    return out.select(
        *TEL_IDS, *[F.round(c, n).alias(c) for c, n in digits.items()], "quality_flag", "heartbeat", "anomaly", "anomaly_type"
    )


@query(
    "augment_faults",
    "AUG1 AUG2 AUG3 AUG4 AUG5 AUG7",
    _inject_sql(6.0, 25, 5.0, 10.0, 90, 0.12, 1.0, 0.0),
)
def augment_faults(spark, sf):
    return _injected(spark, sf, aug.DEFAULTS)


@query("augment_faults_single_table", "AUG6 AUG7", _inject_sql(8.0, 30, 2.5, 5.0, 100, 0.05, 0.8, -0.5))
def augment_faults_single_table(spark, sf):
    return _injected(spark, sf, aug.LAB_VALUES)
