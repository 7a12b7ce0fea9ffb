"""Prediction tables, metric records and the leaderboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and order of the columns of predictions and metric records.
KEEP = ("row_id", "timestamp", "element_id", "subsystem", "anomaly")

METRICS = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("family", T.StringType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in (
            "train_time_s", "predict_time_s", "threshold", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "pa_f1",
        )
    ]
    + [T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn", "tn", "n_scored")]
    + [T.StructField("per_fault", T.MapType(T.StringType(), T.DoubleType()))]
)


def prediction_table(df: DataFrame, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Whichever identifying columns exist, with the score and the flag."""
    keep = [c for c in ("model", *KEEP) if c in df.columns]
    return df.select(*keep, F.col(score).alias("anomaly_score"), F.col(predicted).cast("int").alias("predicted"))


def save_predictions(df: DataFrame, path: str) -> None:
    """Write predictions by model; a re-run replaces only the models that it contains."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def load_predictions(spark: SparkSession, path: str, columns: Sequence[str], rows: DataFrame | None = None) -> DataFrame:
    """All models' predictions, pruned to the wanted columns and rows."""
    found = spark.read.parquet(path).select(*columns)
    return found.join(rows.select("row_id"), "row_id", "left_semi") if rows is not None else found


def save_metrics(df: DataFrame, path: str, version: int) -> None:
    """Append one JSON record per model; floats rounded to 4 digits."""
    cols = [
        F.round(f.name, 4).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema
    ]
    stamped = df.select(*cols, F.lit(version).alias("version"))
    stamped.write.mode("append").partitionBy("version").json(path)


def load_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of each model."""
    schema = T.StructType([*METRICS.fields, T.StructField("version", T.IntegerType())])
    rows = spark.read.schema(schema).json(path)
    latest = Window.partitionBy("model").orderBy(F.col("version").desc())
    return rows.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") == 1).drop("_rank", "version")


def name_from_path(path_column: str = "_path"):
    """``.../<name>_metrics.json`` -> name."""
    return F.regexp_extract(path_column, r"([^/]+)_metrics\.json", 1)


def gather_metrics(spark: SparkSession, glob: str) -> DataFrame:
    """One record per ``*_metrics.json`` file, the model named by its file."""
    fields = [f for f in METRICS.fields if f.name != "model"]
    rows = spark.read.schema(T.StructType(fields)).option("multiLine", True).json(glob)
    return rows.withColumn("_path", F.input_file_name()).withColumn("model", name_from_path()).drop("_path")


def leaderboard(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """Rounded records with rows per second, in registry order; unknown models last.

    ``registry``: model, ord.
    """
    seconds = F.coalesce(F.col("predict_time_s"), F.lit(0.0))
    joined = metrics.join(registry, "model", "left")
    # What a leaderboard rounds to four digits.
    digits = ("precision", "recall", "f1", "roc_auc", "pr_auc", "pa_f1", "threshold")
    return joined.select(
        "model",
        "family",
        F.round("train_time_s", 3).alias("train_time_s"),
        F.round(seconds, 3).alias("predict_time_s"),
        F.when(seconds > 0, F.round(F.coalesce("n_scored", F.lit(0)) / seconds)).alias("rows_per_s"),
        *[F.round(c, 4).alias(c) for c in digits],
        F.coalesce("fp", F.lit(-1)).alias("fp"),
        F.coalesce("fn", F.lit(-1)).alias("fn"),
        F.coalesce("ord", F.lit(999)).alias("ord"),
    ).orderBy("ord", "model")
