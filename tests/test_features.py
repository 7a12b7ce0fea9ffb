"""Features on hand-made series and against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as feat
from tidemark.plans.ordered import over_series
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(("s",), ("t",), ("id",))


def frame(spark, values, name="x", series="a"):
    rows = [(series, i, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"s string, t long, id long, {name} double")


def column(df, make, back=20, ahead=1):
    def build(rows, keyed):
        return rows.withColumn("y", make(keyed.window()))

    return [r["y"] for r in over_series(df, SPEC, build, back, ahead).orderBy("t").collect()]


def test_gradient_edges(spark):
    assert column(frame(spark, [5]), lambda w: feat.gradient_column("x", w)) == [0.0]
    assert column(frame(spark, [5, 8]), lambda w: feat.gradient_column("x", w)) == [3.0, 3.0]
    assert column(frame(spark, [1, 2, 4, 8]), lambda w: feat.gradient_column("x", w)) == list(np.gradient([1.0, 2, 4, 8]))


def test_counter_wraps_and_freezes(spark):
    assert column(frame(spark, [254, 255, 0, 1, 1]), lambda w: feat.counter_delta_column("x", w)) == [1, 1, 1, 1, 0]


def test_steps_since_alarm(spark):
    got = column(frame(spark, [0, 0, 1, 0, 0]), lambda w: feat.since_alarm_column("x", w))
    assert got == [10000, 10000, 0, 1, 2]


def test_ewma_small_and_longer_than_its_reach(spark):
    def run(values):
        df = frame(spark, values)
        out = over_series(df, SPEC, lambda r, k: feat.add_ewma(r, k, ["x"]), back=feat.ewma_reach())
        return [r["x_ewma"] for r in out.orderBy("t").collect()]

    assert run([1, 2, 4]) == pytest.approx([1, 15 / 13, 269 / 169])
    values = np.random.default_rng(0).normal(100, 30, 900)
    assert run(values) == pytest.approx(pd.Series(values).ewm(span=12, adjust=False).mean().tolist(), rel=1e-12)


def test_rolling_std_of_one_row_is_zero(spark):
    got = column(frame(spark, [3, 5]), lambda w: feat.rolling_columns(["x"], w)["x_roll_std"])
    assert got == pytest.approx([0.0, 2**0.5])


def test_rolling_correlation_needs_three_rows(spark):
    df = frame(spark, [1, 2, 3, 4]).withColumn("z", -F.col("x"))
    got = column(df, lambda w: feat.rolling_correlation_column("x", "z", w), back=30)
    assert got[:2] == [0.0, 0.0] and got[2:] == pytest.approx([-1.0, -1.0])


@pytest.fixture(scope="module")
def telemetry(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s, n in (("a", 130), ("b", 57), ("c", 1)):
        for i in range(n):
            rows.append(
                (
                    s, i, len(rows), "sub", *rng.normal(10, 2, 4).round(4).tolist(), abs(float(rng.normal(0, 0.2))),
                    int((i * 3 + 250) % 256), int(rng.integers(0, 3)), int(rng.random() < 0.1), int(rng.random() < 0.1), "normal",
                )
            )
    names = "s string, t long, id long, subsystem string, temperature double, pressure double, voltage double, current double, error_rate double, heartbeat int, quality_flag int, alarm int, anomaly int, anomaly_type string"
    return spark.createDataFrame(rows, names)


def by_id(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


def test_split_plan_gives_the_same_features(spark, telemetry, monkeypatch):
    plain = by_id(feat.add_features(telemetry, SPEC))
    monkeypatch.setattr(feat, "ALARM_CAP", 60)
    small = by_id(feat.add_features(telemetry, SPEC))
    spark.conf.set("spark.tidemark.maxGroupRows", "40")
    try:
        split = by_id(feat.add_features(telemetry, SPEC))
    finally:
        spark.conf.unset("spark.tidemark.maxGroupRows")
    pd.testing.assert_frame_equal(small, split[small.columns], rtol=1e-12)
    assert len(plain) == len(split) == 188
    assert list(plain.columns) == list(split.columns)


def test_features_match_pandas(telemetry):
    got = by_id(feat.add_features(telemetry, SPEC))
    base = telemetry.toPandas().sort_values(["s", "t"])
    g = base.groupby("s")["current"]
    for name, want in {
        "current_roll_mean": g.transform(lambda x: x.rolling(15, min_periods=1).mean()),
        "current_roll_std": g.transform(lambda x: x.rolling(15, min_periods=1).std()).fillna(0.0),
        "current_roll_median": g.transform(lambda x: x.rolling(15, min_periods=1).median()),
        "current_lag5": g.shift(5).fillna(0.0),
        "current_roc": g.diff().fillna(0.0),
        "current_ewma": g.transform(lambda x: x.ewm(span=12, adjust=False).mean()),
    }.items():
        np.testing.assert_allclose(got[name], want.loc[base.sort_values("id").index], rtol=1e-9, atol=1e-9)


def test_model_inputs_hide_labels_and_alarm(telemetry):
    df = feat.add_features(telemetry.withColumnRenamed("s", "element_id"), SeriesSpec(("element_id",), ("t",), ("id",)))
    names = feat.feature_columns(df)
    assert not {"anomaly", "alarm", "time_since_alarm", "alarm_freq", "heartbeat"} & set(names)
    assert len([n for n in names if n not in ("t", "id")]) == 41
    with pytest.raises(ValueError):
        feat.feature_array(df, ["temperature", "anomaly"])


def test_causal_features_ignore_later_rows(telemetry):
    early = telemetry.filter("t < 50")
    full = by_id(feat.add_features(telemetry, SPEC)).query("t < 49")
    part = by_id(feat.add_features(early, SPEC)).query("t < 49")
    causal = [c for c in feat.engineered_columns(feat.add_features(early, SPEC)) if not c.endswith("_grad")]
    pd.testing.assert_frame_equal(
        full.set_index("id")[causal], part.set_index("id")[causal], check_exact=False, rtol=1e-12
    )


def test_batches_agree_with_the_window_expressions(spark):
    """Missing values, frames across batch edges and a series longer than any frame."""
    rng = np.random.default_rng(4)
    pick = lambda v: None if rng.random() < 0.15 else v
    rows = [
        (s, i, n, *[pick(float(v)) for v in rng.normal(10, 2, 5).round(3)], pick(int(rng.integers(0, 256))), 0, pick(int(rng.random() < 0.02)))
        for n, (s, i) in enumerate([("a", i) for i in range(700)] + [(None, i) for i in range(90)] + [("c", 0)])
    ]
    names = "s string, t long, id long, temperature double, pressure double, voltage double, current double, error_rate double, heartbeat int, quality_flag int, alarm int"
    df = spark.createDataFrame(rows, names)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = by_id(feat.add_features(df, SPEC))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def build(part, keyed):
        w = keyed.window()
        cols = feat.rolling_columns(("temperature", "current"), w) | feat.lag_columns(("voltage",), w)
        cols |= {"pressure_roc": feat.change_column("pressure", w), "pressure_grad": feat.gradient_column("pressure", w)}
        cols |= {"time_since_alarm": feat.since_alarm_column("alarm", w), "alarm_freq": feat.alarm_rate_column("alarm", w)}
        cols |= {"temp_curr_corr": feat.rolling_correlation_column("temperature", "current", w)}
        cols |= {"heartbeat_delta": feat.counter_delta_column("heartbeat", w)}
        return feat.add_ewma(part, keyed, ("current",)).select("*", *[c.alias(n) for n, c in cols.items()])

    want = by_id(over_series(df, SPEC, build, back=300, ahead=1).na.fill(0.0))
    assert len(got) == 791
    for c in set(want.columns) & set(feat.engineered_columns(feat.add_features(df, SPEC))):
        np.testing.assert_array_equal(got[c], want[c], err_msg=c)


def test_features_need_no_window_operator(telemetry):
    """Window expressions took some 400 microseconds a row and core; the batches take some ten."""
    plan = feat.add_features(telemetry, SPEC)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
