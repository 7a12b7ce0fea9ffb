"""Expressions and keys that several text operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words.
GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SOLID = r"[^\x20\x09-\x0D]"

SALTS = 16


def whole(text: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(SOLID))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns), ``id``, ``body`` and ``key``, whatever other columns are called.

    (id, key) names a document; rows that share both share text and id, so what holds for one holds for all.
    """
    return docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
        docs[id_col].alias("id"),
        whole(docs[text_col]).alias("body"),
    ).withColumn("key", F.xxhash64("body"))


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row`` again, some of them replaced."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in columns])


def salt(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salted(table: DataFrame) -> DataFrame:
    """Each row once per salt: the small side of a join whose large side has hot keys."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set as the session's checkpoint folder.

    Only a session without that setting (a test) gets one beside its warehouse.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: a checkpoint."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """As ``cut``, as a compressed table, for what is large."""
    path = f"{shared_folder(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
