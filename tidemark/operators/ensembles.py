"""Cross-model analysis: coverage, agreement, greedy cover and vote ensembles.

Predictions are one long table ``(model, row_id, ..., predicted)``.  A model that has
no prediction for a row counts as 0, which a sum over the rows it did predict gives
for free, so the rows are never multiplied by the models.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.evaluation import rates
from tidemark.plans.stages import checkpointed

BASELINE = "alarm_baseline"


def restrict_rows(predictions: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Predictions on the given rows only."""
    return predictions.join(rows.select(row_id), row_id, "left_semi")


def coverage(
    predictions: DataFrame,
    rows: DataFrame,
    row_id: str = "row_id",
    kind: str = "anomaly_type",
    alarm: str = "alarm",
    normal: str = "normal",
) -> DataFrame:
    """Recall per (model, anomaly type), with the plain alarm as a baseline model."""
    typed = rows.filter(F.col(kind) != normal).select(row_id, kind, alarm)
    base = typed.groupBy(kind).agg(F.avg(F.col(alarm).cast("double")).alias("coverage"))
    base = base.select(F.lit(BASELINE).alias("model"), kind, "coverage")
    joined = predictions.select("model", row_id, "predicted").join(typed.select(row_id, kind), row_id)
    found = joined.groupBy("model", kind).agg(F.avg(F.col("predicted").cast("double")).alias("coverage"))
    return found.unionByName(base)


def coverage_wide(cover: DataFrame, kinds: Sequence[str], kind: str = "anomaly_type") -> DataFrame:
    """One row per model and one column per type; null where a model saw no such row."""
    return cover.groupBy("model").pivot(kind, list(kinds)).agg(F.first("coverage"))


def best_per_type(cover: DataFrame, kind: str = "anomaly_type") -> DataFrame:
    """The model of the highest coverage per type, first by name on ties, baseline left out."""
    models = cover.filter(F.col("model") != BASELINE)
    ordered = Window.partitionBy(kind).orderBy(F.col("coverage").desc(), F.col("model"))
    best = models.withColumn("_rank", F.row_number().over(ordered)).filter(F.col("_rank") == 1)
    return best.select(kind, "model", "coverage")


def anomaly_types(rows: DataFrame, kind: str = "anomaly_type", normal: str = "normal") -> DataFrame:
    return rows.filter(F.col(kind) != normal).select(kind).distinct().orderBy(kind)


def catch_matrix(
    predictions: DataFrame, rows: DataFrame, models: Sequence[str], row_id: str = "row_id", label: str = "anomaly"
) -> DataFrame:
    """One row per true anomaly and one 0/1 column per model."""
    truth = rows.filter(F.col(label) == 1).select(row_id)
    votes = predictions.join(truth, row_id, "left_semi").groupBy(row_id)
    wide = votes.agg(*[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models])
    return truth.join(wide, row_id, "left").na.fill(0, list(models))


def agreement(
    predictions: DataFrame, rows: DataFrame, models: Sequence[str], row_id: str = "row_id", label: str = "anomaly"
) -> DataFrame:
    """Correlation of the catch vectors of every pair of models; null for a constant vector.

    The vectors are 0/1, so joint counts are enough: one pass sums them for all pairs of
    the (few) models, rows combine before the shuffle, and no pair of rows is formed.
    """
    wide = catch_matrix(predictions, rows, models, row_id, label)
    pairs = [(a, b) for a in models for b in models]
    sums = wide.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(m).cast("double")).alias(f"s_{i}") for i, m in enumerate(models)],
        *[F.sum((F.col(a) * F.col(b)).cast("double")).alias(f"p_{i}") for i, (a, b) in enumerate(pairs)],
    )
    where = {m: i for i, m in enumerate(models)}
    entries = F.array(
        *[
            F.struct(
                F.lit(a).alias("model_a"),
                F.lit(b).alias("model_b"),
                F.col(f"s_{where[a]}").alias("sa"),
                F.col(f"s_{where[b]}").alias("sb"),
                F.col(f"p_{i}").alias("both"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    flat = sums.select("n", F.explode(entries).alias("e")).select("n", "e.*")
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    spread = F.sqrt((n * sa - sa * sa) * (n * sb - sb * sb))
    return flat.select("model_a", "model_b", F.when(spread > 0, (n * F.col("both") - sa * sb) / spread).alias("corr"))


def greedy_cover(
    predictions: DataFrame, rows: DataFrame, models: Sequence[str], row_id: str = "row_id", label: str = "anomaly"
) -> DataFrame:
    """Greedy union coverage: (rank, model, gain, cumulative recall).

    Only the distinct catch patterns matter.  They are counted once, and each of the at
    most ``len(models)`` rounds aggregates the counts of the patterns not yet covered.
    The loop stops after the first model without a gain, which is still listed.
    """
    spark = predictions.sparkSession
    wide = catch_matrix(predictions, rows, models, row_id, label)
    patterns = checkpointed(wide.groupBy(*models).agg(F.count(F.lit(1)).alias("n")))
    total = patterns.agg(F.sum("n")).first()[0] or 0
    left, order, covered = list(models), [], 0
    open_rows = F.lit(True)
    while left and total:
        gains = patterns.filter(open_rows).agg(
            *[F.coalesce(F.sum(F.when(F.col(m) == 1, F.col("n"))), F.lit(0)).alias(m) for m in left]
        ).first()
        best = min(left, key=lambda m: (-gains[m], m))
        covered += gains[best]
        order.append((len(order) + 1, best, int(gains[best]), covered / total))
        left.remove(best)
        open_rows = open_rows & (F.col(best) != 1)
        if gains[best] == 0:
            break
    return spark.createDataFrame(order, "rank int, model string, gain long, cumulative_recall double")


def votes(
    predictions: DataFrame, rows: DataFrame, combos: Mapping[str, Sequence[str]], row_id: str = "row_id"
) -> DataFrame:
    """Votes of each named combination on each row of ``rows`` (label kept)."""
    wide = rows.join(
        predictions.groupBy(row_id).agg(
            *[
                F.sum(F.when(F.col("model").isin(list(members)), F.col("predicted")).otherwise(0)).alias(name)
                for name, members in combos.items()
            ]
        ),
        row_id,
        "left",
    )
    return wide.na.fill(0, list(combos))


def or_flag(votes_col: str):
    """Any member flags the row."""
    return (F.col(votes_col) >= 1).cast("int")


def majority_flag(votes_col: str, members: int):
    """At least floor((m+1)/2) members flag the row; half is enough when m is even."""
    return (F.col(votes_col) >= (members + 1) // 2).cast("int")


def ensemble_table(
    predictions: DataFrame,
    rows: DataFrame,
    combos: Mapping[str, Sequence[str]],
    models: Sequence[str],
    row_id: str = "row_id",
    label: str = "anomaly",
) -> DataFrame:
    """Precision, recall and F1 of every model and every combination on the common rows.

    Rows first collapse to (label, predicted per model) patterns, combined before the
    shuffle; all candidates are then rated on the pattern counts in one aggregate.
    """
    wide = rows.select(row_id, label).join(
        predictions.groupBy(row_id).agg(
            *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(m) for m in models]
        ),
        row_id,
        "left",
    ).na.fill(0, list(models))
    patterns = wide.groupBy(label, *models).agg(F.count(F.lit(1)).alias("n"))

    flags = {f"(single) {m}": F.col(m) == 1 for m in models}
    for name, wanted in combos.items():
        members = [m for m in wanted if m in models]
        if not members:
            continue
        count = sum((F.col(m) for m in members), F.lit(0))
        flags[f"OR[{name}]"] = count >= 1
        if len(members) >= 3:
            flags[f"MAJORITY[{name}]"] = count >= (len(members) + 1) // 2

    def weight(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    y = F.col(label) == 1
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("ensemble"),
                weight(y & hit).alias("tp"),
                weight(~y & hit).alias("fp"),
                weight(y & ~hit).alias("fn"),
            )
            for name, hit in flags.items()
        ]
    )
    counts = patterns.agg(entries.alias("e")).select(F.explode("e").alias("e")).select("e.*")
    return counts.withColumns(rates()).select("ensemble", "precision", "recall", "f1")


def top_ensembles(table: DataFrame, n: int = 15) -> DataFrame:
    """The best combinations by F1, name order on ties."""
    return table.orderBy(F.col("f1").desc(), F.col("ensemble")).limit(n)

