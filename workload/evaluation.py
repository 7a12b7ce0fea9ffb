"""Queries over thresholds, metrics and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import thresholds as th
from tidemark.operators.windows import temporal_split
from tidemark.plans.ordered import with_position
from workload.catalog import query
from workload.roles import (
    EV_W,
    EVENTS,
    EVENTS_SQL,
    MODEL_SCORES_SQL,
    SCORED_SQL,
    TELEMETRY_SQL,
    events,
    model_scores,
    predictions,
    scored,
    telemetry,
)

_COUNTS = """CAST(sum(CASE WHEN label = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN label = 0 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND predicted = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 0 AND predicted = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn"""
_PRF = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"""


@query("agg_confusion", "AGG1", f"WITH {MODEL_SCORES_SQL} SELECT model, {_COUNTS} FROM preds GROUP BY model")
def agg_confusion(spark, sf):
    return ev.confusion(predictions(spark, sf), ["model"])


@query(
    "agg_precision_recall",
    "AGG2 AGG1",
    f"""WITH {MODEL_SCORES_SQL}, c AS (SELECT model, subsystem, {_COUNTS} FROM preds GROUP BY model, subsystem),
    q AS (SELECT *, {_PRF} FROM c)
    SELECT model, subsystem, round(p, 6) AS "precision", round(r, 6) AS recall,
           round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
           round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM q""",
)
def agg_precision_recall(spark, sf):
    out = ev.precision_recall(ev.confusion(predictions(spark, sf), ["model", "subsystem"]))
    return out.select("model", "subsystem", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(
    "agg_best_threshold",
    "AGG4",
    f"WITH {MODEL_SCORES_SQL} SELECT model, threshold FROM thr",
)
def agg_best_threshold(spark, sf):
    return th.best_threshold(th.score_cuts(model_scores(spark, sf), ["model"]), ["model"])


@query(
    "agg_best_threshold_global",
    "AGG4",
    f"""WITH {SCORED_SQL}, b AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scored GROUP BY score),
    c AS (SELECT score, CAST(sum(n) OVER (ORDER BY score DESC) AS DOUBLE) AS k,
                 CAST(sum(pos) OVER (ORDER BY score DESC) AS DOUBLE) AS tp,
                 CAST(sum(n) OVER () AS DOUBLE) AS n_rows, CAST(sum(pos) OVER () AS DOUBLE) AS n_pos FROM b)
    SELECT score AS threshold FROM c WHERE k <= greatest(1, floor(n_rows / 2))
    ORDER BY 2.0 * tp / (k + n_pos) DESC, score DESC LIMIT 1""",
)
def agg_best_threshold_global(spark, sf):
    return th.best_threshold(th.score_cuts(scored(spark, sf), []), [])


_SWEEP_SQL = f"""
grid AS (SELECT DISTINCT model, round(unnest(quantile_cont(score, {th.sweep_probs()!r})), 6) AS threshold
  FROM ms GROUP BY model),
sw AS (SELECT g.model, g.threshold, CAST(max(c.k) AS DOUBLE) AS k, CAST(max(c.tp) AS DOUBLE) AS tp, max(c.n_pos) AS n_pos
  FROM grid g JOIN cuts c ON c.model = g.model AND c.score >= g.threshold GROUP BY g.model, g.threshold),
pr AS (SELECT *, tp / k AS p, tp / n_pos AS r FROM sw),
sf AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0 END AS f1 FROM pr),
best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS rk2 FROM sf)
"""


@query(
    "agg_threshold_sweep",
    "AGG5 JOI7 AGG14",
    f"""WITH {MODEL_SCORES_SQL}, {_SWEEP_SQL}
    SELECT model, threshold, round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1
    FROM best WHERE rk2 = 1""",
)
def agg_threshold_sweep(spark, sf):
    out = th.sweep_threshold(model_scores(spark, sf), ["model"], digits=6)
    return out.select("model", "threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "join_scores_thresholds",
    "JOI7",
    f"""WITH {MODEL_SCORES_SQL}, t(threshold) AS (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]::DOUBLE[]))
    SELECT model, threshold, count(*) FILTER (score >= threshold) AS k,
           CAST(coalesce(sum(label) FILTER (score >= threshold), 0) AS BIGINT) AS tp
    FROM ms, t GROUP BY model, threshold""",
)
def join_scores_thresholds(spark, sf):
    ms = model_scores(spark, sf)
    cuts = th.score_cuts(ms, ["model"])
    options = F.array(*[F.lit(t) for t in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0)])
    grid = ms.select("model").distinct().select("model", F.explode(options).alias("threshold"))
    return th.cuts_at_thresholds(cuts, grid, ["model"]).select("model", "threshold", "k", "tp")


@query(
    "agg_roc_auc",
    "AGG6",
    f"""WITH {MODEL_SCORES_SQL} SELECT model, round(sum((n - pos) * (tp - pos / 2.0)) / (max(n_pos) * (max(n_rows) - max(n_pos))), 6)
    AS roc_auc FROM cuts GROUP BY model""",
)
def agg_roc_auc(spark, sf):
    out = ev.ranking_metrics(th.score_cuts(model_scores(spark, sf), ["model"]), ["model"])
    return out.select("model", F.round("roc_auc", 6).alias("roc_auc"))


@query(
    "agg_roc_curve",
    "AGG6",
    f"""WITH {MODEL_SCORES_SQL} SELECT model, score, round((k - tp) / (n_rows - n_pos), 6) AS fpr,
    round(tp / n_pos, 6) AS tpr FROM cuts""",
)
def agg_roc_curve(spark, sf):
    out = ev.roc_curve(th.score_cuts(model_scores(spark, sf), ["model"]), ["model"])
    return out.select("model", "score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "agg_average_precision",
    "AGG7",
    f"""WITH {MODEL_SCORES_SQL}, l AS (SELECT *, tp / n_pos AS recall, tp / k AS prec,
      coalesce(lag(tp / n_pos) OVER (PARTITION BY model ORDER BY score DESC), 0) AS before FROM cuts)
    SELECT model, round(sum((recall - before) * prec), 6) AS pr_auc, round(max(n_pos) / max(n_rows), 6) AS base_rate
    FROM l GROUP BY model""",
)
def agg_average_precision(spark, sf):
    out = ev.ranking_metrics(th.score_cuts(model_scores(spark, sf), ["model"]), ["model"])
    return out.select("model", F.round("pr_auc", 6).alias("pr_auc"), F.round("base_rate", 6).alias("base_rate"))


@query(
    "agg_pr_curve",
    "AGG7",
    f"""WITH {MODEL_SCORES_SQL} SELECT model, score, round(tp / n_pos, 6) AS recall, round(tp / k, 6) AS "precision" FROM cuts""",
)
def agg_pr_curve(spark, sf):
    out = ev.pr_curve(th.score_cuts(model_scores(spark, sf), ["model"]), ["model"])
    return out.select("model", "score", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


_FULL_SQL = f"""WITH {MODEL_SCORES_SQL},
marked AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY model, element_id ORDER BY ts, row_id), 0) <> 1
    THEN 1 ELSE 0 END AS st FROM preds),
seg AS (SELECT *, sum(st) OVER (PARTITION BY model, element_id ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) AS sid FROM marked),
adj AS (SELECT *, CASE WHEN label = 1 THEN max(predicted) OVER (PARTITION BY model, element_id, label, sid) ELSE predicted END AS pa FROM seg),
c AS (SELECT model, max(threshold) AS threshold, {_COUNTS},
      CAST(sum(CASE WHEN label = 1 AND pa = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS ptp,
      CAST(sum(CASE WHEN label = 0 AND pa = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pfp,
      CAST(sum(CASE WHEN label = 1 AND pa = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS pfn FROM adj GROUP BY model),
rank_m AS (SELECT model, sum((n - pos) * (tp - pos / 2.0)) / (max(n_pos) * (max(n_rows) - max(n_pos))) AS roc_auc,
      sum(pos * tp / k) / max(n_pos) AS pr_auc FROM cuts GROUP BY model),
q AS (SELECT c.*, {_PRF}, rank_m.roc_auc, rank_m.pr_auc, CASE WHEN ptp + pfp > 0 THEN ptp / (ptp + pfp) ELSE 0 END AS pp,
      CASE WHEN ptp + pfn > 0 THEN ptp / (ptp + pfn) ELSE 0 END AS pr FROM c JOIN rank_m USING (model))
SELECT model, threshold, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(p, 6) AS "precision",
       round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1,
       round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
       round(CASE WHEN pp + pr > 0 THEN 2 * pp * pr / (pp + pr) ELSE 0 END, 6) AS pa_f1, tp, fp, fn, tn FROM q"""


@query("eval_full_metrics", "AGG3 AGG1 AGG2 AGG4 AGG6 AGG7 WIN11 WIN13 PRJ6", _FULL_SQL)
def eval_full_metrics(spark, sf):
    out = ev.compute_metrics(model_scores(spark, sf), EVENTS, ["model"])
    digits = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "pa_f1")
    return out.select("model", "threshold", *[F.round(c, 6).alias(c) for c in digits], "tp", "fp", "fn", "tn")


# Named intervals of positions, as the laboratory evaluation names its faults.
FAULTS = [("early", 0, 12), ("middle", 20, 45), ("late", 50, 70)]


@query(
    "agg_fault_coverage",
    "AGG11 JOI8",
    f"""WITH {SCORED_SQL}, p AS (SELECT *, row_number() OVER ({EV_W}) - 1 AS step,
      CASE WHEN score >= 2.0 THEN 1 ELSE 0 END AS predicted FROM scored),
    f(name, s, e) AS (VALUES ('early', 0, 12), ('middle', 20, 45), ('late', 50, 70))
    SELECT name, round(avg(predicted), 6) AS coverage FROM p JOIN f ON step >= s AND step < e GROUP BY name""",
)
def agg_fault_coverage(spark, sf):
    faults = spark.createDataFrame(FAULTS, "name string, start long, end long")
    df = with_position(scored(spark, sf), EVENTS, "pos").withColumn("step", F.col("pos") - 1)
    df = df.withColumn("predicted", (F.col("score") >= 2.0).cast("int"))
    out = ev.fault_coverage(df, faults, "step")
    return out.select("name", F.round("coverage", 6).alias("coverage"))


@query(
    "agg_sweep_record",
    "AGG5 AGG11 SRC6",
    f"""WITH {MODEL_SCORES_SQL}, {_SWEEP_SQL},
    pos AS (SELECT row_id, row_number() OVER ({EV_W}) - 1 AS step FROM ev),
    fl AS (SELECT ms.*, step, b.threshold, CASE WHEN ms.score >= b.threshold THEN 1 ELSE 0 END AS hit
      FROM ms JOIN (SELECT * FROM best WHERE rk2 = 1) b USING (model) JOIN pos USING (row_id)),
    mk AS (SELECT *, CASE WHEN label = 1 AND coalesce(lag(label) OVER (PARTITION BY model, element_id ORDER BY ts, row_id), 0) <> 1
      THEN 1 ELSE 0 END AS st FROM fl),
    sg AS (SELECT *, sum(st) OVER (PARTITION BY model, element_id ORDER BY ts, row_id ROWS UNBOUNDED PRECEDING) AS sid FROM mk),
    aj AS (SELECT *, CASE WHEN label = 1 THEN max(hit) OVER (PARTITION BY model, element_id, label, sid) ELSE hit END AS pa FROM sg),
    pc AS (SELECT model, max(threshold) AS threshold, CAST(sum(label * pa) AS DOUBLE) AS tp,
      CAST(sum((1 - label) * pa) AS DOUBLE) AS fp, CAST(sum(label * (1 - pa)) AS DOUBLE) AS fn,
      avg(hit) FILTER (step >= 0 AND step < 12) AS early, avg(hit) FILTER (step >= 20 AND step < 45) AS middle,
      avg(hit) FILTER (step >= 50 AND step < 70) AS late FROM aj GROUP BY model),
    par AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pp,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rr FROM pc)
    SELECT model, threshold, round(pp, 6) AS pa_precision, round(rr, 6) AS pa_recall,
      round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END, 6) AS pa_f1,
      round(early, 6) AS early, round(middle, 6) AS middle, round(late, 6) AS late FROM par""",
)
def agg_sweep_record(spark, sf):
    faults = spark.createDataFrame(FAULTS, "name string, start long, end long")
    steps = with_position(events(spark, sf), EVENTS, "pos").select("row_id", (F.col("pos") - 1).alias("step"))
    df = model_scores(spark, sf).join(steps, "row_id")
    out = ev.sweep_record(df, EVENTS, ["model"], faults, "step", digits=6)
    cover = [F.round(F.try_element_at("per_fault", F.lit(n)), 6).alias(n) for n, _, _ in FAULTS]
    return out.select("model", "threshold", *[F.round(c, 6).alias(c) for c in ("pa_precision", "pa_recall", "pa_f1")], *cover)


@query(
    "agg_reference_series",
    "AGG12 WIN10 JOI2",
    f"""WITH {EVENTS_SQL}, p AS (SELECT *, row_number() OVER ({EV_W}) AS rn,
      count(*) OVER (PARTITION BY element_id) AS n FROM ev),
    t AS (SELECT * FROM p WHERE rn > floor(n * 0.6)),
    b AS (SELECT element_id FROM t GROUP BY element_id ORDER BY sum(anomaly) DESC, element_id LIMIT 1)
    SELECT row_id FROM t WHERE element_id IN (SELECT element_id FROM b)""",
)
def agg_reference_series(spark, sf):
    test = temporal_split(events(spark, sf), EVENTS, 0.6).filter("is_train = 0")
    return ev.reference_rows(test, EVENTS, "anomaly")


@query(
    "agg_dataset_summary",
    "AGG13",
    f"""WITH {TELEMETRY_SQL} SELECT count(*) AS n_rows, count(DISTINCT element_id) AS n_series,
    count(DISTINCT subsystem) AS n_subsystems, round(avg(anomaly), 6) AS anomaly_rate, round(avg(alarm), 6) AS alarm_rate FROM tel""",
)
def agg_dataset_summary(spark, sf):
    out = ev.dataset_summary(telemetry(spark, sf), "element_id", "subsystem", "anomaly", "alarm")
    return out.withColumns({c: F.round(c, 6) for c in ("anomaly_rate", "alarm_rate")})


@query(
    "agg_type_counts",
    "AGG13 PRJ7",
    f"WITH {TELEMETRY_SQL} SELECT anomaly_type, count(*) AS n FROM tel GROUP BY anomaly_type",
)
def agg_type_counts(spark, sf):
    return ev.type_counts(telemetry(spark, sf), "anomaly_type")


@query(
    "agg_quantiles",
    "AGG14",
    f"""WITH {EVENTS_SQL}, q AS (SELECT element_id, unnest([0.01, 0.5, 0.98]::DOUBLE[]) AS prob,
      unnest(quantile_cont(value, [0.01, 0.5, 0.98])) AS quantile FROM ev GROUP BY element_id)
    SELECT element_id, prob, round(quantile, 5) AS quantile FROM q""",
)
def agg_quantiles(spark, sf):
    out = th.exact_quantiles(events(spark, sf), ["element_id"], "value", [0.01, 0.5, 0.98])
    return out.select("element_id", "prob", F.round("quantile", 5).alias("quantile"))


@query(
    "agg_score_histogram",
    "AGG15",
    f"""WITH {SCORED_SQL}, e AS (SELECT min(score) AS lo, quantile_cont(score, 0.999) AS hi FROM scored)
    SELECT CAST(least(floor((score - lo) / ((hi - lo) / 59)), 58) AS BIGINT) AS bin, label AS class, count(*) AS n
    FROM scored, e WHERE score <= hi GROUP BY ALL""",
)
def agg_score_histogram(spark, sf):
    return ev.score_histogram(scored(spark, sf))


@query(
    "agg_class_weights",
    "AGG17",
    f"""WITH {TELEMETRY_SQL}, c AS (SELECT count(*)::DOUBLE AS n, sum(anomaly)::DOUBLE AS p FROM tel)
    SELECT round(n / (2 * p), 6) AS w_pos, round(n / (2 * (n - p)), 6) AS w_neg, round((n - p) / p, 6) AS neg_pos_ratio FROM c""",
)
def agg_class_weights(spark, sf):
    out = ev.class_weights(telemetry(spark, sf), "anomaly")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_TAIL_SQL = f"""
u AS (SELECT subsystem, quantile_cont(value, 0.98) AS u FROM ev GROUP BY subsystem),
x AS (SELECT ev.subsystem, u.u, CASE WHEN value > u.u THEN value - u.u END AS x FROM ev JOIN u USING (subsystem)),
mo AS (SELECT subsystem, u, count(*)::DOUBLE AS n, count(x)::DOUBLE AS nt, avg(x) AS m, var_samp(x) AS v FROM x GROUP BY subsystem, u),
gp AS (SELECT *, 0.5 * (1 - m * m / v) AS xi, 0.5 * m * (1 + m * m / v) AS sigma FROM mo)
"""


@query(
    "pot_threshold_by_moments",
    "AGG20 DET14",
    f"""WITH {EVENTS_SQL}, {_TAIL_SQL}
    SELECT subsystem, round(u, 5) AS u, CAST(nt AS BIGINT) AS n_tail, round(xi, 5) AS xi, round(sigma, 5) AS sigma,
           round(CASE WHEN abs(xi) < 1e-6 THEN u + sigma * ln(nt / (1e-3 * n))
                 ELSE u + sigma / xi * (pow(1e-3 * n / nt, -xi) - 1) END, 4) AS zq FROM gp""",
)
def pot_threshold_by_moments(spark, sf):
    out = th.pot_threshold(events(spark, sf), ["subsystem"], "value")
    return out.select(
        "subsystem", F.round("u", 5).alias("u"), "n_tail", F.round("xi", 5).alias("xi"),
        F.round("sigma", 5).alias("sigma"), F.round("zq", 4).alias("zq"),
    )


@query("pot_threshold_by_likelihood", "AGG20 DET14")
def pot_threshold_by_likelihood(spark, sf):
    return th.pot_threshold(events(spark, sf), ["subsystem"], "value", method="likelihood")


@query(
    "cost_threshold",
    "DET21 JOI7",
    f"""WITH {SCORED_SQL}, h AS (SELECT quantile_cont(score, 0.99) AS base FROM scored WHERE label = 0),
    f AS (SELECT (5 + i) / 10.0::DOUBLE AS multiplier FROM range(0, 76) t(i)),
    w AS (SELECT multiplier, multiplier * round(base, 6) AS threshold FROM f, h),
    r AS (SELECT multiplier, threshold, sum(CASE WHEN score > threshold THEN CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE -0.3 END
            ELSE CASE WHEN label = 1 THEN -1.0 ELSE 0.01 END END) AS reward FROM scored, w GROUP BY ALL)
    SELECT multiplier, round(threshold, 6) AS threshold, round(reward, 4) AS reward FROM r
    ORDER BY round(reward, 6) DESC, multiplier LIMIT 1""",
)
def cost_threshold(spark, sf):
    s = scored(spark, sf)
    base = th.exact_quantiles(s.filter("label = 0"), [], "score", [0.99])
    base = base.select(F.round("quantile", 6).alias("base"))
    out = th.cost_threshold(s, base, [])
    return out.select("multiplier", F.round("threshold", 6).alias("threshold"), F.round("reward", 4).alias("reward"))
