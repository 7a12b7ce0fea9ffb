"""Line dedup: three-line windows that an earlier document, or an earlier place, holds already are removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, SOLID, packed, salt, salted, unpacked

SPAN = 3


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, GAP, " ")))


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, at, window): windows over the lines that hold a word; ``at`` counts those lines from 0."""
    d = packed(docs, id_col, text_col).select(
        "id",
        "key",
        F.transform(
            F.filter(F.split("body", "\n"), lambda x: x.rlike(SOLID)), lambda x: F.xxhash64(_normal(x))
        ).alias("lines"),
    )
    windows = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (SPAN - 1)), lambda i: F.xxhash64(F.slice(F.col("lines"), i, SPAN))
    )
    return d.filter(F.size("lines") >= SPAN).select("id", "key", F.posexplode(windows).alias("at", "window"))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_, key_, covered): the lines of each document, counted from 0 among those with a word, that go."""
    seen = _windows(docs, id_col, text_col)
    first = (
        seen.groupBy("window")
        .agg(F.min(F.struct("id", "key", "at")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("window", "first")
    )
    later = (
        seen.withColumn("salt", salt("id", "key", "at"))
        .join(salted(first), ["window", "salt"])
        .filter(~F.struct("id", "key", "at").eqNullSafe(F.col("first")))
    )
    return (
        later.groupBy("id", "key")
        .agg(F.collect_set("at").alias("starts"))
        .select(
            F.col("id").alias("id_"),
            F.col("key").alias("key_"),
            F.array_distinct(
                F.flatten(F.transform("starts", lambda i: F.sequence(i, i + (SPAN - 1))))
            ).alias("covered"),
        )
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None
) -> DataFrame:
    """All rows and columns; in the text column, the lines of later occurrences are gone. ``count_col``, if given, is
    one more column with their number.

    The first occurrence of a window is that of the least (id, hash of the text, place), a null id before others. A
    window is three successive lines with a word, compared in lower case with single spaces; lines without a word are
    not compared and stay. Texts of fewer lines, null and empty texts stay as they are; repeated rows are one document
    and get the same text. A text that holds nothing new becomes the lines that no window covers, or empty.
    """
    cover = covered_lines(docs, id_col, text_col)
    d = packed(docs, id_col, text_col).join(
        cover, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left"
    )
    lines = F.split("body", "\n")
    solid = F.transform(lines, lambda x: F.when(x.rlike(SOLID), x))
    places = F.filter(F.transform(solid, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    d = d.withColumn("lines", lines).withColumn("places", F.when(F.col("covered").isNotNull(), places))
    d = d.withColumn("drop", F.transform("covered", lambda i: F.get(F.col("places"), i)))
    left = F.array_except(
        F.transform(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: i), F.coalesce("drop", F.array().cast("array<int>"))
    )
    d = d.withColumn("left", F.when(F.col("covered").isNotNull(), left))
    text = F.when(F.col("covered").isNull(), F.col(f"row.`{text_col}`")).otherwise(
        F.array_join(F.transform("left", lambda i: F.get(F.col("lines"), i)), "\n")
    )
    if count_col is None:
        return unpacked(d, docs.columns, **{text_col: text})
    n = F.coalesce(F.size("covered"), F.lit(0)).cast("long")
    d = d.withColumn("row", F.struct("row.*", n.alias(count_col)))
    return unpacked(d, [*docs.columns, count_col], **{text_col: text})

