"""The given tables read as telemetry: once in Spark and once as SQL with the same names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import rolling_columns
from tidemark.operators.thresholds import best_threshold, flag, score_cuts
from tidemark.plans.ordered import POS, over_series
from tidemark.plans.sizing import join_on
from tidemark.spec import SeriesSpec

EVENTS = SeriesSpec(("element_id",), ("ts", "row_id"), ("row_id",))
TELEMETRY = SeriesSpec(
    ("element_id",),
    ("ts", "orderkey", "linenumber", "partkey", "temperature", "current"),
    ("orderkey", "linenumber", "partkey", "element_id"),
)
LAB = SeriesSpec(("subsystem",), ("ts", "row_id"), ("row_id",))
MODELS = ("counter", "jump", "level", "roll_dev")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    label = (F.col("event_type") == "error").cast("int")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("element_id"),
        "ts",
        F.col("event_type").alias("subsystem"),
        "value",
        k.alias("k"),
        (F.col("value") > 150).cast("int").alias("alarm"),
        label.alias("anomaly"),
        F.when(label == 1, F.concat(F.lit("fault_"), (k % 5).cast("int").cast("string")))
        .otherwise("normal")
        .alias("anomaly_type"),
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id AS row_id, user_id AS element_id, ts, event_type AS subsystem, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CASE WHEN value > 150 THEN 1 ELSE 0 END AS alarm,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS anomaly,
         CASE WHEN event_type = 'error'
              THEN 'fault_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR)
              ELSE 'normal' END AS anomaly_type
  FROM events)
"""


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    q = F.col("l_quantity")
    label = (F.col("l_returnflag") == "R").cast("int")
    return li.select(
        F.col("l_suppkey").alias("element_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_linestatus").alias("subsystem"),
        q.alias("temperature"),
        F.col("l_tax").alias("pressure"),
        F.col("l_discount").alias("voltage"),
        F.col("l_extendedprice").alias("current"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("error_rate"),
        (F.col("l_orderkey") % 256).cast("int").alias("heartbeat"),
        F.when(q >= 48, 2).when(q >= 45, 1).otherwise(0).alias("quality_flag"),
        (F.col("l_discount") >= 0.09).cast("int").alias("alarm"),
        label.alias("anomaly"),
        F.when(label == 1, F.concat(F.lit("fault_"), F.col("l_linenumber").cast("string")))
        .otherwise("normal")
        .alias("anomaly_type"),
    )


TELEMETRY_SQL = """
tel AS (
  SELECT l_suppkey AS element_id, l_shipdate AS ts, l_orderkey AS orderkey, l_linenumber AS linenumber,
         l_partkey AS partkey, l_linestatus AS subsystem, l_quantity AS temperature, l_tax AS pressure,
         l_discount AS voltage, l_extendedprice AS current, abs(l_discount - l_tax) AS error_rate,
         CAST(l_orderkey % 256 AS INTEGER) AS heartbeat,
         CASE WHEN l_quantity >= 48 THEN 2 WHEN l_quantity >= 45 THEN 1 ELSE 0 END AS quality_flag,
         CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END AS alarm,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS anomaly,
         CASE WHEN l_returnflag = 'R' THEN 'fault_' || CAST(l_linenumber AS VARCHAR) ELSE 'normal' END AS anomaly_type
  FROM lineitem)
"""
TEL_W = "PARTITION BY element_id ORDER BY ts, orderkey, linenumber, partkey, temperature, current"
EV_W = "PARTITION BY element_id ORDER BY ts, row_id"
TEL_IDS = ["orderkey", "linenumber", "partkey", "element_id"]


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """events with a trailing-deviation score, rounded so that both engines see equal scores."""

    def build(rows: DataFrame, keyed: SeriesSpec) -> DataFrame:
        w = keyed.window()
        cols = rolling_columns(["value", "k"], w)
        jump = F.abs(F.col("value") - F.lag("value").over(w))
        return rows.select(
            "*",
            *[cols[c].alias(c) for c in ("value_roll_mean", "value_roll_std", "k_roll_mean")],
            F.coalesce(jump, F.lit(0.0)).alias("jump"),
        )

    out = over_series(events(spark, sf), EVENTS, build, back=14).drop(POS)
    dev = F.abs(F.col("value") - F.col("value_roll_mean")) / F.greatest(F.col("value_roll_std"), F.lit(1e-6))
    return out.select(
        "row_id", "element_id", "ts", "subsystem", "value", "k", "alarm",
        F.col("anomaly").alias("label"), "anomaly_type",
        F.round(dev, 6).alias("score"),
        F.round("jump", 6).alias("jump"),
        F.round(F.abs(F.col("k") - F.col("k_roll_mean")), 6).alias("counter"),
    )


SCORED_SQL = (
    EVENTS_SQL
    + f""",
rolled AS (
  SELECT *, avg(value) OVER r AS m, coalesce(stddev_samp(value) OVER r, 0) AS s, avg(k) OVER r AS km,
         lag(value) OVER (w) AS prev
  FROM ev WINDOW w AS ({EV_W}), r AS ({EV_W} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
scored AS (
  SELECT row_id, element_id, ts, subsystem, value, k, alarm, anomaly AS label, anomaly_type,
         round(abs(value - m) / greatest(s, 1e-6), 6) AS score,
         round(coalesce(abs(value - prev), 0), 6) AS jump,
         round(abs(k - km), 6) AS counter
  FROM rolled)
"""
)


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Four scores of the same rows as one long table, unfolded in a single pass."""
    s = scored(spark, sf)
    entries = F.array(
        F.struct(F.lit("counter").alias("model"), F.col("counter").alias("score")),
        F.struct(F.lit("jump").alias("model"), F.col("jump").alias("score")),
        F.struct(F.lit("level").alias("model"), F.col("value").alias("score")),
        F.struct(F.lit("roll_dev").alias("model"), F.col("score").alias("score")),
    )
    base = ["row_id", "element_id", "ts", "subsystem", "label", "alarm", "anomaly_type"]
    return s.select(*base, F.explode(entries).alias("e")).select(*base, "e.model", "e.score")


BASE = "row_id, element_id, ts, subsystem, label, alarm, anomaly_type"
MODEL_SCORES_SQL = (
    SCORED_SQL
    + f""",
ms AS (
  SELECT {BASE}, 'counter' AS model, counter AS score FROM scored
  UNION ALL SELECT {BASE}, 'jump', jump FROM scored
  UNION ALL SELECT {BASE}, 'level', value FROM scored
  UNION ALL SELECT {BASE}, 'roll_dev', score FROM scored),
blocks AS (
  SELECT model, score, count(*) AS n, sum(label) AS pos FROM ms GROUP BY model, score),
cuts AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY model ORDER BY score DESC) AS DOUBLE) AS k,
         CAST(sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS DOUBLE) AS tp,
         CAST(sum(n) OVER (PARTITION BY model) AS DOUBLE) AS n_rows,
         CAST(sum(pos) OVER (PARTITION BY model) AS DOUBLE) AS n_pos
  FROM blocks),
rated AS (
  SELECT *, 2.0 * tp / (k + n_pos) AS f1,
         row_number() OVER (PARTITION BY model ORDER BY 2.0 * tp / (k + n_pos) DESC, score DESC) AS rk
  FROM cuts WHERE k <= greatest(1, floor(n_rows / 2))),
thr AS (SELECT model, score AS threshold, f1, k, tp, n_rows, n_pos FROM rated WHERE rk = 1),
preds AS (
  SELECT ms.*, CASE WHEN ms.score >= thr.threshold THEN 1 ELSE 0 END AS predicted, thr.threshold
  FROM ms JOIN thr USING (model))
"""
)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The four models flagged at their best F1 threshold."""
    ms = model_scores(spark, sf)
    thresholds = best_threshold(score_cuts(ms, ["model"]), ["model"])
    joined = join_on(ms, thresholds, ["model"])
    return joined.withColumn("predicted", flag(F.col("score"), F.col("threshold")))


def labelled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("row_id", "element_id", "ts", "anomaly", "anomaly_type", "alarm")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as double arrays."""
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
