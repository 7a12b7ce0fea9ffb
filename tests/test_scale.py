"""Steps that must not gather rows, walk options row by row, or do a pass twice."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.scaling import apply_scaler, fit_scaler
from tidemark.operators.augment import rule_alarm
from tidemark.operators.detectors.forest import WALKED_ROWS, IsolationForest, _grow, path_correction
from tidemark.operators.thresholds import exact_quantiles
from tidemark.plans.sizing import join_few
from tidemark.plans.stages import written


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_large_group_are_not_brought_together(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"))
    stats = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = join_few(rows, stats, ["g"])
        assert "BroadcastHashJoin" in planned(out) and "SortMergeJoin" not in planned(out)
        assert out.filter("g IS NULL").first().n == 334 and out.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rule_alarm_sends_its_bands_and_keeps_rows_without_subsystem(spark):
    cells = [(i, s, 10.0 + (i == 3) * 50, 1.0, 0.0, 0) for i, s in enumerate(["a", "a", None, "a", "z"])]
    df = spark.createDataFrame(cells, "id int, subsystem string, temperature double, voltage double, error_rate double, quality_flag int")
    bands = spark.createDataFrame(
        [("a", 10.0, 5.0, 1.0, 1.0), (None, 0.0, 0.0, 0.0, 0.0)],
        "subsystem string, temp_mean double, temp_band double, voltage_mean double, voltage_band double",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rule_alarm(df, bands)
        assert "SortMergeJoin" not in planned(out)
        assert [r.rule_alarm for r in out.orderBy("id").collect()] == [0, 0, 0, 1, 0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quantiles_of_large_groups_meet_wanted_ranks_only(spark, split_plans):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(0, 1, 300), "b": rng.integers(0, 5, 90).astype(float), "c": np.array([2.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    probs = [0.0, 0.25, 0.5, 0.7012, 0.999, 1.0]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs)
    assert "filter(array(0.0" not in got._jdf.queryExecution().toString()
    found = {(r.k, r.prob): r.quantile for r in got.collect()}
    assert len(found) == 18
    for (k, p), q in found.items():
        np.testing.assert_allclose(q, np.quantile(values[k], p), rtol=1e-12)


def test_flat_walk_of_the_forest_is_the_walk_node_by_node():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (WALKED_ROWS + 300, 4))
    grown = [_grow(x[rng.choice(len(x), 64, replace=False)], rng, 6) for _ in range(5)]
    width = max(map(len, grown))
    tables = [np.array([[*[n[k] for n in t], *[-1 if k == 0 else 0] * (width - len(t))] for t in grown]) for k in range(5)]
    forest = IsolationForest(64, tables[0].astype(np.int32), tables[1], *[t.astype(np.int32) for t in tables[2:4]], tables[4], 7)

    def path(row):
        total = 0.0
        for t in grown:
            node = t[0]
            while node[0] >= 0:
                node = t[node[2] if row[node[0]] < node[1] else node[3]]
            total += node[4]
        return 2.0 ** (-total / len(grown) / float(path_correction(64)))

    np.testing.assert_allclose(forest.score_matrix(x), [path(r) for r in x], rtol=1e-12)


def test_scaled_rows_do_not_carry_the_fit(spark):
    df = spark.range(50).select((F.col("id") * 2.0).alias("x"), F.lit(3.0).alias("same"))
    out = apply_scaler(df, fit_scaler(df, ["x", "same"]), ["x", "same"])
    assert "Aggregate" not in planned(out) and "Join" not in planned(out)
    row = out.agg(F.avg("x"), F.stddev_pop("x"), F.max(F.abs("same"))).first()
    np.testing.assert_allclose(list(row), [0.0, 1.0, 0.0], atol=1e-12)


def test_written_tables_are_read_back_without_their_plan(spark):
    df = spark.range(20).withColumn("x", F.rand(1)).repartition(3)
    out = written(df, "test")
    assert "Exchange" not in planned(out) and out.schema.names == df.schema.names
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
