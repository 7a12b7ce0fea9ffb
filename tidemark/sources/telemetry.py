"""Reading and writing telemetry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANNEL_FIELDS = [T.StructField(c, T.DoubleType()) for c in ("temperature", "pressure", "voltage", "current", "error_rate")]
UNLABELED = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("element_id", T.StringType()),
        T.StructField("subsystem", T.StringType()),
        *CHANNEL_FIELDS,
        T.StructField("heartbeat", T.IntegerType()),
        T.StructField("quality_flag", T.IntegerType()),
        T.StructField("alarm", T.IntegerType()),
    ]
)
GROUND_TRUTH = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("anomaly", T.IntegerType()),
        T.StructField("anomaly_type", T.StringType()),
    ]
)
LABELED = T.StructType([*UNLABELED.fields, *GROUND_TRUTH.fields[1:]])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, kind: str = "parquet") -> DataFrame:
    """A table with a stated schema.  No global sort: windows state their order.

    CSV has a header, and columns are taken by its names in any order; what the file lacks is null.
    """
    if kind == "csv":
        found = spark.read.option("header", True).csv(path)
        if schema is None:
            return found
        have = set(found.columns)
        cast = lambda f: F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        return found.select(*[cast(f).cast(f.dataType).alias(f.name) for f in schema])
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(kind).load(path)


def load_labeled(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return read_table(spark, path, LABELED, kind)


def load_unlabeled(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return read_table(spark, path, UNLABELED, kind)


def load_ground_truth(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return read_table(spark, path, GROUND_TRUTH, kind)


def load_pair(spark: SparkSession, train: str, test: str, label: str = "anomaly", kind: str = "parquet"):
    """Training table, test table without its label, and the label apart."""
    tests = read_table(spark, test, None, kind)
    return read_table(spark, train, None, kind), tests.drop(label), tests.select(label)


def attach_ground_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Labels by row id, for evaluation only."""
    return df.join(truth, "row_id", "left")


def write_views(df: DataFrame, folder: str, kind: str = "parquet") -> None:
    """The labeled, unlabeled and ground-truth projections of one table."""
    views = {
        "labeled": df,
        "unlabeled": df.drop("anomaly", "anomaly_type"),
        "ground_truth": df.select("row_id", "anomaly", "anomaly_type"),
    }
    for name, view in views.items():
        view.write.mode("overwrite").option("header", True).format(kind).save(f"{folder}/{name}")


def minute_timestamp(start: str, step: Column) -> Column:
    """start + step minutes."""
    return F.timestamp_add("MINUTE", step, F.lit(start).cast("timestamp_ntz"))


def element_name(name: Column, number: Column) -> Column:
    """``Name_00`` ids."""
    return F.format_string("%s_%02d", name, number)
