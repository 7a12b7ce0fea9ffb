"""Confusion counts, curves, full metric records and histograms, all as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import adjusted_counts, number_segments
from tidemark.operators.thresholds import (
    best_threshold,
    exact_quantiles,
    f1_of,
    flag,
    safe_ratio,
    score_cuts,
    sweep_threshold,
)
from tidemark.plans.sizing import join_on
from tidemark.spec import SeriesSpec

HISTOGRAM_BINS = 59
HISTOGRAM_TOP = 0.999


def confusion(df: DataFrame, keys: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn per group."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    return df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def rates(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    """Precision, recall and F1 over count columns, 0 on a zero denominator."""
    precision = safe_ratio(F.col(tp), F.col(tp) + F.col(fp))
    recall = safe_ratio(F.col(tp), F.col(tp) + F.col(fn))
    return {"precision": precision, "recall": recall, "f1": f1_of(precision, recall)}


def precision_recall(counts: DataFrame) -> DataFrame:
    """Add precision, recall, F1 and accuracy to confusion counts."""
    everything = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumns({**rates(), "accuracy": (F.col("tp") + F.col("tn")) / F.greatest(everything, F.lit(1))})


def ranking_metrics(cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null when a class is missing.

    With running counts per distinct score both are plain sums, so no curve is walked.
    """
    neg = F.col("n") - F.col("pos")
    won = F.sum(neg * (F.col("tp") - F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * F.col("tp") / F.col("k"))
    sums = cuts.groupBy(*keys).agg(
        won.alias("won"), steps.alias("steps"), F.max("n_pos").alias("n_pos"), F.max("n_rows").alias("n_rows")
    )
    n_neg = F.col("n_rows") - F.col("n_pos")
    both = (F.col("n_pos") > 0) & (n_neg > 0)
    return sums.select(
        *keys,
        F.when(both, F.col("won") / (F.col("n_pos") * n_neg)).alias("roc_auc"),
        F.when(F.col("n_pos") > 0, F.col("steps") / F.col("n_pos")).otherwise(0.0).alias("pr_auc"),
        F.when(F.col("n_rows") > 0, F.col("n_pos") / F.col("n_rows")).alias("base_rate"),
    )


def roc_curve(cuts: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """False and true positive rate at every distinct score."""
    return cuts.select(
        *keys,
        score,
        ((F.col("k") - F.col("tp")) / (F.col("n_rows") - F.col("n_pos"))).alias("fpr"),
        (F.col("tp") / F.col("n_pos")).alias("tpr"),
    )


def pr_curve(cuts: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Recall and precision at every distinct score."""
    return cuts.select(
        *keys, score, (F.col("tp") / F.col("n_pos")).alias("recall"), (F.col("tp") / F.col("k")).alias("precision")
    )


def compute_metrics(
    df: DataFrame,
    spec: SeriesSpec,
    keys: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """The full metric record of each group (for example each model) of scored rows.

    ``df`` has the group keys, the series columns, the score and the label.  With no
    given thresholds the best F1 threshold is used.
    """
    keys = list(keys)
    cuts = score_cuts(df, keys, score, label)
    if thresholds is None:
        thresholds = best_threshold(cuts, keys, score)
    grouped = SeriesSpec((*keys, *spec.series), spec.order, spec.row_id)
    flagged = join_on(df, thresholds, keys)
    flagged = flagged.withColumn("predicted", flag(F.col(score), F.col("threshold")))
    slim = list(dict.fromkeys([*grouped.series, *spec.order, label, "predicted"]))
    numbered = number_segments(flagged.select(*slim), grouped, label)
    adjusted = adjusted_counts(numbered, spec, keys, label, "predicted")
    counts = precision_recall(confusion(flagged, keys, label, "predicted"))
    adjusted = adjusted.select(*keys, rates("pa_tp", "pa_fp", "pa_fn")["f1"].alias("pa_f1"))
    record = join_on(join_on(join_on(counts, thresholds, keys), ranking_metrics(cuts, keys), keys), adjusted, keys)
    return record.select(
        *keys, "threshold", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "pa_f1", "tp", "fp", "fn", "tn"
    )


def fault_coverage(df: DataFrame, faults: DataFrame, step: str, predicted: str = "predicted") -> DataFrame:
    """Share of flagged steps in each named interval [start, end).

    Spark broadcasts the intervals if they are small; a longer list meets the rows by blocks of its own choice.
    """
    inside = (F.col(step) >= F.col("start")) & (F.col(step) < F.col("end"))
    return df.join(faults, inside).groupBy("name").agg(F.avg(predicted).alias("coverage"))


def sweep_record(
    df: DataFrame,
    spec: SeriesSpec,
    keys: Sequence[str],
    faults: DataFrame,
    step: str,
    score: str = "score",
    label: str = "label",
    digits: int | None = None,
) -> DataFrame:
    """The record of the threshold sweep: its cut with plain and point-adjusted rates and the coverage of each fault.

    ``faults`` names intervals of ``step``; ``per_fault`` maps those that hold rows to their share of flagged rows.
    """
    keys = list(keys)
    swept = sweep_threshold(df, keys, score, label, digits)
    flagged = join_on(df, swept.select(*keys, "threshold"), keys)
    flagged = flagged.withColumn("predicted", flag(F.col(score), F.col("threshold")))
    grouped = SeriesSpec((*keys, *spec.series), spec.order, spec.row_id)
    slim = list(dict.fromkeys([*grouped.series, *spec.order, label, "predicted"]))
    counts = adjusted_counts(number_segments(flagged.select(*slim), grouped, label), spec, keys, label, "predicted")
    rated = rates("pa_tp", "pa_fp", "pa_fn")
    adjusted = counts.select(*keys, *[rated[c].alias(f"pa_{c}") for c in ("precision", "recall", "f1")])
    inside = (F.col(step) >= F.col("start")) & (F.col(step) < F.col("end"))
    covered = flagged.join(faults, inside).groupBy(*keys, "name").agg(F.avg("predicted").alias("coverage"))
    # one entry per named fault
    covered = covered.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "coverage")))).alias("per_fault")
    )
    return join_on(join_on(swept, adjusted, keys), covered, keys, "left")


def reference_series(df: DataFrame, spec: SeriesSpec, label: str = "label") -> DataFrame:
    """The series with the most positive rows; the first by key on ties."""
    key = spec.series[0]
    counts = df.groupBy(*spec.series).agg(F.sum(F.col(label).cast("long")).alias("n_pos"))
    return counts.orderBy(F.col("n_pos").desc(), F.col(key)).limit(1)


def reference_rows(df: DataFrame, spec: SeriesSpec, label: str = "label") -> DataFrame:
    """Row ids of the reference series."""
    return df.join(F.broadcast(reference_series(df, spec, label)), list(spec.series), "left_semi").select(*spec.row_id)


def dataset_summary(df: DataFrame, series: str, subsystem: str, label: str, alarm: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(series).alias("n_series"),
        F.countDistinct(subsystem).alias("n_subsystems"),
        F.avg(F.col(label).cast("double")).alias("anomaly_rate"),
        F.avg(F.col(alarm).cast("double")).alias("alarm_rate"),
    )


def type_counts(df: DataFrame, kind: str) -> DataFrame:
    """Rows per type, most frequent first."""
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(kind))


def score_histogram(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    bins: int = HISTOGRAM_BINS,
    top: float = HISTOGRAM_TOP,
    overflow: bool = False,
) -> DataFrame:
    """Counts per (bin, class) on equal bins from the minimum to the top quantile.

    The upper edge belongs to the last bin.  Scores above the top quantile are outside of the plotted range; with
    ``overflow`` they are counted in a bin behind the last one.
    """
    low = df.agg(F.min(score).alias("lo"))
    high = exact_quantiles(df.select(score), [], score, [top]).select(F.col("quantile").alias("hi"))
    edges = low.join(F.broadcast(high))
    ranged = df.join(F.broadcast(edges))
    above = F.col(score) > F.col("hi")
    ranged = ranged if overflow else ranged.filter(~above)
    width = (F.col("hi") - F.col("lo")) / bins
    inside = F.least(F.floor((F.col(score) - F.col("lo")) / width), F.lit(bins - 1))
    bin_no = F.when(above, bins).otherwise(inside).cast("long")
    return ranged.groupBy(bin_no.alias("bin"), F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n/(2*n_c) of both classes and the negative/positive ratio."""
    n, pos = F.count(F.lit(1)), F.sum(F.col(label).cast("long"))
    return df.agg(n.alias("n"), pos.alias("n_pos")).select(
        safe_ratio(F.col("n"), 2.0 * F.col("n_pos")).alias("w_pos"),
        safe_ratio(F.col("n"), 2.0 * (F.col("n") - F.col("n_pos"))).alias("w_neg"),
        ((F.col("n") - F.col("n_pos")) / F.greatest(F.col("n_pos"), F.lit(1))).alias("neg_pos_ratio"),
    )
