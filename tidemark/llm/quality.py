"""Quality rules: repetition inside a text and lines that recur over the documents of a host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, lines_of, packed, salt, salted, unpacked, words_of

WINDOW = 8


@dataclass(frozen=True)
class QualityRules:
    """Limits. A line is frequent on a host with ``line_docs`` different texts or more, however large the host is."""

    min_words: int = 20
    repeat_percent: int = 30
    line_docs: int = 20
    left_share: float = 0.3


def _normal(text: Column) -> Column:
    """Letters in lower case with one space between runs, and line ends; lines are trimmed after the split."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\n]+", " "))


def _paired(hashes: str, gap: int) -> Column:
    return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(F.col(hashes), i + gap)))


def _measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    d = packed(docs, id_col, text_col).select(
        "id", "key", F.coalesce(F.col(f"row.`{host_col}`").cast("string"), F.lit("")).alias("host"), "body"
    )
    d = d.withColumn("words", words_of(F.col("body"))).withColumn("lines", lines_of(F.col("body")))
    # hashes of two, four and eight words, each from two of half the length
    d = d.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    for k in (1, 2, 4):
        d = d.withColumn(f"h{2 * k}", _paired(f"h{k}", k))
    d = d.withColumn("windows", F.when(F.size("words") >= WINDOW, F.slice("h8", 1, F.size("words") - (WINDOW - 1))))
    # only texts with a window found twice are sorted; neighbours in that order show which ones
    d = d.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col("sorted")
    d = d.withColumn(
        "found",
        F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        ),
    )
    p = F.col("found")
    steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    return d.select(
        "id",
        "key",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(
            F.col("body").rlike(r"[#*$%&|<>]"), F.length("body") - F.length(F.translate("body", "#*$%&|<>", ""))
        )
        .otherwise(0)
        .cast("long")
        .alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.filter(
            F.transform(
                F.split(_normal(F.col("body")), "\n"),
                lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), F.length(F.trim(x)).alias("chars")),
            ),
            lambda x: x["chars"] > 0,
        ).alias("lines"),
    )


def _frequent(measured: DataFrame, rules: QualityRules) -> DataFrame:
    """(host, h) of lines in ``line_docs`` different texts of the host or more; equal texts are one."""
    per_text = measured.select("host", "key", F.explode("lines.h").alias("h")).distinct()
    return per_text.groupBy("host", "h").count().filter(F.col("count") >= rules.line_docs).select("host", "h")


def _judged(docs: DataFrame, rules: QualityRules, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per input row, without its text: measures, ``frequent`` (hashes of its frequent lines) and verdicts."""
    measured = cut(_measured(docs, id_col, text_col, host_col))
    lines = measured.select("id", "key", "host", F.explode("lines.h").alias("h"))
    hit = (
        lines.withColumn("salt", salt("id", "key"))
        .join(salted(_frequent(measured, rules)), ["host", "h", "salt"], "left_semi")
        .groupBy("id", "key", "host")
        .agg(F.collect_set("h").alias("frequent"))
        .withColumnsRenamed({"id": "id_", "key": "key_", "host": "host_"})
    )
    d = measured.join(
        hit,
        F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("host") == F.col("host_")),
        "left",
    ).drop("id_", "key_", "host_")
    removed = F.filter("lines", lambda x: F.array_contains(F.col("frequent"), x["h"]))
    zero = F.lit(0).cast("long")
    d = d.withColumn("line_chars", F.aggregate("lines", zero, lambda a, x: a + x["chars"])).withColumn(
        "removed_chars", F.coalesce(F.aggregate(removed, zero, lambda a, x: a + x["chars"]), zero)
    )
    d = d.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.repeat_percent),
    )
    depleted = F.col("line_chars") - F.col("removed_chars") < F.col("line_chars") * rules.left_share
    return d.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Measures and verdict of every row, null texts read as empty and a null host as a host of its own.

    An empty text has no words and fails. Repeated rows each give a row; rows of equal texts count as one document in
    the line counts, so that exact copies do not make their own lines frequent.
    Very long texts are measured whole. Other columns are neither read nor returned.
    """
    return _judged(docs, rules, id_col, text_col, host_col).select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "line_chars",
        "removed_chars",
        "kept",
    )


def clean(
    docs: DataFrame,
    rules: QualityRules = QualityRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """The rows that the rules keep, with all their columns and without their frequent lines.

    Texts without a frequent line stay as they are. An empty table gives an empty one.
    """
    verdict = (
        _judged(docs, rules, id_col, text_col, host_col)
        .filter("kept")
        .groupBy("id", "key", "host")
        .agg(F.first("frequent").alias("frequent"))
        .withColumnsRenamed({"id": "id_", "key": "key_", "host": "host_"})
    )
    d = packed(docs, id_col, text_col)
    kept = d.join(
        verdict,
        d["id"].eqNullSafe(F.col("id_"))
        & (d["key"] == F.col("key_"))
        & (F.coalesce(d[f"row.`{host_col}`"].cast("string"), F.lit("")) == F.col("host_")),
    )
    left = F.filter(
        F.split("body", "\n"), lambda x: ~F.array_contains(F.col("frequent"), F.xxhash64(F.trim(_normal(x))))
    )
    text = F.when(F.col("frequent").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(left, "\n"))
    return unpacked(kept, docs.columns, **{text_col: text})
