"""Queries of the cross-model analysis and of the joins that feed it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ensembles as en
from tidemark.operators.windows import temporal_split
from workload.catalog import query
from workload.roles import (
    EV_W,
    EVENTS,
    EVENTS_SQL,
    MODEL_SCORES_SQL,
    MODELS,
    events,
    labelled_rows,
    predictions,
)

COMBOS = {
    "trend": ("jump", "level"),
    "windowed": ("counter", "jump", "roll_dev"),
    "all": MODELS,
}

_TEST_SQL = f"""
pos AS (SELECT *, row_number() OVER ({EV_W}) AS rn, count(*) OVER (PARTITION BY element_id) AS n FROM ev),
test AS (SELECT row_id, element_id, ts, anomaly, anomaly_type, alarm FROM pos WHERE rn > floor(n * 0.6))
"""


def test_rows(spark, sf):
    """The common test rows: the last 40 % of every series."""
    split = temporal_split(labelled_rows(spark, sf), EVENTS, 0.6)
    return split.filter("is_train = 0").drop("is_train")


@query(
    "join_ground_truth",
    "JOI1 SRC2 JOI3",
    f"""WITH {EVENTS_SQL} SELECT e.row_id, e.value, g.anomaly, g.anomaly_type FROM ev e
    LEFT JOIN (SELECT row_id, anomaly, anomaly_type FROM ev) g USING (row_id)""",
)
def join_ground_truth(spark, sf):
    all_rows = events(spark, sf)
    truth = all_rows.select("row_id", "anomaly", "anomaly_type")
    return all_rows.drop("anomaly", "anomaly_type").join(truth, "row_id", "left").select(
        "row_id", "value", "anomaly", "anomaly_type"
    )


@query(
    "join_restrict_rows",
    "JOI2 SRC7",
    f"WITH {MODEL_SCORES_SQL}, {_TEST_SQL} SELECT model, row_id, predicted FROM preds WHERE row_id IN (SELECT row_id FROM test)",
)
def join_restrict_rows(spark, sf):
    return en.restrict_rows(predictions(spark, sf).select("model", "row_id", "predicted"), test_rows(spark, sf)).select(
        "model", "row_id", "predicted"
    )


@query(
    "prj_anomaly_types",
    "PRJ7",
    f"WITH {EVENTS_SQL} SELECT DISTINCT anomaly_type FROM ev WHERE anomaly_type <> 'normal'",
)
def prj_anomaly_types(spark, sf):
    return en.anomaly_types(labelled_rows(spark, sf))


_COVER_SQL = """
cov AS (
  SELECT 'alarm_baseline' AS model, anomaly_type, avg(alarm) AS coverage FROM ev WHERE anomaly_type <> 'normal' GROUP BY anomaly_type
  UNION ALL SELECT model, anomaly_type, avg(predicted) FROM preds WHERE anomaly_type <> 'normal' GROUP BY model, anomaly_type)
"""


@query(
    "agg_type_coverage",
    "AGG8 AGG9 JOI3",
    f"WITH {MODEL_SCORES_SQL}, {_COVER_SQL} SELECT model, anomaly_type, round(coverage, 6) AS coverage FROM cov",
)
def agg_type_coverage(spark, sf):
    cover = en.coverage(predictions(spark, sf), labelled_rows(spark, sf))
    return cover.select("model", "anomaly_type", F.round("coverage", 6).alias("coverage"))


_KINDS = [f"fault_{i}" for i in range(5)] + ["fault_absent"]


@query(
    "agg_type_coverage_wide",
    "AGG8 AGG9",
    f"WITH {MODEL_SCORES_SQL}, {_COVER_SQL} SELECT model, "
    + ", ".join(f"round(max(CASE WHEN anomaly_type = '{k}' THEN coverage END), 6) AS {k}" for k in _KINDS)
    + " FROM cov GROUP BY model",
)
def agg_type_coverage_wide(spark, sf):
    wide = en.coverage_wide(en.coverage(predictions(spark, sf), labelled_rows(spark, sf)), _KINDS)
    return wide.select("model", *[F.round(k, 6).alias(k) for k in _KINDS])


@query(
    "agg_best_model_per_type",
    "AGG10",
    f"""WITH {MODEL_SCORES_SQL}, {_COVER_SQL}, b AS (SELECT *, row_number() OVER
      (PARTITION BY anomaly_type ORDER BY coverage DESC, model) AS rk2 FROM cov WHERE model <> 'alarm_baseline')
    SELECT anomaly_type, model, round(coverage, 6) AS coverage FROM b WHERE rk2 = 1""",
)
def agg_best_model_per_type(spark, sf):
    best = en.best_per_type(en.coverage(predictions(spark, sf), labelled_rows(spark, sf)))
    return best.select("anomaly_type", "model", F.round("coverage", 6).alias("coverage"))


@query(
    "set_catch_matrix",
    "SET6 JOI4",
    f"WITH {MODEL_SCORES_SQL}, {_TEST_SQL} SELECT t.row_id, "
    + ", ".join(f"max(CASE WHEN p.model = '{m}' THEN p.predicted ELSE 0 END) AS {m}" for m in MODELS)
    + " FROM test t LEFT JOIN preds p USING (row_id) WHERE t.anomaly = 1 GROUP BY t.row_id",
)
def set_catch_matrix(spark, sf):
    return en.catch_matrix(predictions(spark, sf), test_rows(spark, sf), MODELS)


@query(
    "agg_model_agreement",
    "AGG18",
    f"""WITH {MODEL_SCORES_SQL}, {_TEST_SQL},
    c AS (SELECT p.model, p.row_id, p.predicted::DOUBLE AS x FROM preds p JOIN test t USING (row_id) WHERE t.anomaly = 1)
    SELECT a.model AS model_a, b.model AS model_b, round(corr(a.x, b.x), 6) + 0.0 AS corr
    FROM c a JOIN c b USING (row_id) GROUP BY a.model, b.model""",
)
def agg_model_agreement(spark, sf):
    out = en.agreement(predictions(spark, sf), test_rows(spark, sf), MODELS)
    return out.select("model_a", "model_b", (F.round("corr", 6) + 0.0).alias("corr"))


@query(
    "set_or_and_majority_votes",
    "SET2 SET3 JOI4",
    f"""WITH {MODEL_SCORES_SQL}, {_TEST_SQL}, v AS (
      SELECT t.row_id, """
    + ", ".join(
        f"sum(CASE WHEN p.model IN ({', '.join(repr(m) for m in ms)}) THEN p.predicted ELSE 0 END) AS v_{name}"
        for name, ms in COMBOS.items()
    )
    + """ FROM test t LEFT JOIN preds p USING (row_id) GROUP BY t.row_id)
    SELECT row_id, """
    + ", ".join(
        f"CASE WHEN v_{name} >= 1 THEN 1 ELSE 0 END AS or_{name}, "
        f"CASE WHEN v_{name} >= {(len(ms) + 1) // 2} THEN 1 ELSE 0 END AS majority_{name}"
        for name, ms in COMBOS.items()
    )
    + " FROM v",
)
def set_or_and_majority_votes(spark, sf):
    v = en.votes(predictions(spark, sf), test_rows(spark, sf).select("row_id"), COMBOS)
    cols = []
    for name, members in COMBOS.items():
        cols += [en.or_flag(name).alias(f"or_{name}"), en.majority_flag(name, len(members)).alias(f"majority_{name}")]
    return v.select("row_id", *cols)


_SINGLE = [("(single) " + m, (m,), 1) for m in MODELS]
_OR = [(f"OR[{n}]", ms, 1) for n, ms in COMBOS.items()]
_MAJ = [(f"MAJORITY[{n}]", ms, (len(ms) + 1) // 2) for n, ms in COMBOS.items() if len(ms) >= 3]
_COMBO_ROWS = ", ".join(f"('{n}', '{m}', {need})" for n, ms, need in _SINGLE + _OR + _MAJ for m in ms)
_ENSEMBLE_SQL = f"""WITH {MODEL_SCORES_SQL}, {_TEST_SQL}, co(ensemble, model, need) AS (VALUES {_COMBO_ROWS}),
v AS (SELECT co.ensemble, t.row_id, max(t.anomaly) AS y, max(need) AS need, sum(coalesce(p.predicted, 0)) AS votes
      FROM test t CROSS JOIN co LEFT JOIN preds p ON p.row_id = t.row_id AND p.model = co.model GROUP BY co.ensemble, t.row_id),
c AS (SELECT ensemble, sum(CASE WHEN y = 1 AND votes >= need THEN 1 ELSE 0 END)::DOUBLE AS tp,
      sum(CASE WHEN y = 0 AND votes >= need THEN 1 ELSE 0 END)::DOUBLE AS fp,
      sum(CASE WHEN y = 1 AND votes < need THEN 1 ELSE 0 END)::DOUBLE AS fn FROM v GROUP BY ensemble),
q AS (SELECT ensemble, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c),
out AS (SELECT ensemble, round(p, 6) AS "precision", round(r, 6) AS recall,
      round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q)
"""


def _ensembles(spark, sf):
    out = en.ensemble_table(predictions(spark, sf), test_rows(spark, sf), COMBOS, MODELS)
    return out.select("ensemble", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("set_ensemble_table", "SET4 SET2 SET3", _ENSEMBLE_SQL + "SELECT * FROM out")
def set_ensemble_table(spark, sf):
    return _ensembles(spark, sf)


@query("sort_top_ensembles", "SRT2", _ENSEMBLE_SQL + "SELECT * FROM out ORDER BY f1 DESC, ensemble LIMIT 5")
def sort_top_ensembles(spark, sf):
    return en.top_ensembles(_ensembles(spark, sf), 5)


def _greedy_sql() -> str:
    """One step after another: the model with the most rows that no earlier one caught, by name among equals."""
    steps = []
    for k in range(1, len(MODELS) + 1):
        taken = " UNION ALL ".join(f"SELECT model FROM g{i}" for i in range(1, k))
        left = f"WHERE model NOT IN ({taken})" if taken else ""
        open_ = f"AND row_id NOT IN (SELECT row_id FROM caught WHERE model IN ({taken}))" if taken else ""
        rounds = f"WHERE (SELECT gain FROM g{k - 1}) > 0" if taken else ""
        steps.append(
            f"""g{k} AS (SELECT * FROM (SELECT {k} AS rank, model, count(row_id) AS gain
  FROM (SELECT DISTINCT model FROM preds {left}) LEFT JOIN (SELECT * FROM caught WHERE true {open_}) USING (model)
  GROUP BY model ORDER BY gain DESC, model LIMIT 1) {rounds})"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM g{k}" for k in range(1, len(MODELS) + 1))
    return f"""WITH {MODEL_SCORES_SQL}, {_TEST_SQL},
caught AS (SELECT DISTINCT p.model, p.row_id FROM preds p JOIN test t USING (row_id) WHERE p.predicted = 1 AND t.anomaly = 1),
{", ".join(steps)}
SELECT rank, model, gain, round(sum(gain) OVER (ORDER BY rank) / (SELECT count(*) FROM test WHERE anomaly = 1), 6) AS cumulative_recall
FROM ({every})"""


@query("set_greedy_cover", "SET5", _greedy_sql())
def set_greedy_cover(spark, sf):
    out = en.greedy_cover(predictions(spark, sf), test_rows(spark, sf), MODELS)
    return out.withColumn("cumulative_recall", F.round("cumulative_recall", 6))


@query(
    "set_concatenate",
    "SET1",
    f"""WITH {EVENTS_SQL}, pos AS (SELECT *, row_number() OVER ({EV_W}) AS rn, count(*) OVER (PARTITION BY element_id) AS n FROM ev)
    SELECT row_id, value FROM pos WHERE rn > floor(n * 0.6) UNION ALL SELECT row_id, value FROM pos WHERE rn <= floor(n * 0.6)""",
)
def set_concatenate(spark, sf):
    split = temporal_split(events(spark, sf), EVENTS, 0.6)
    train, test = split.filter("is_train = 1"), split.filter("is_train = 0")
    return test.select("row_id", "value").unionByName(train.select("row_id", "value"))


@query(
    "sort_series_time",
    "SRT1",
    f"WITH {EVENTS_SQL} SELECT row_id, element_id, ts FROM ev ORDER BY element_id, ts, row_id",
)
def sort_series_time(spark, sf):
    return events(spark, sf).select("row_id", "element_id", "ts").orderBy("element_id", "ts", "row_id")
