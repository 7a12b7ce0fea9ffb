import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import augment as aug
from tidemark.spec import SeriesSpec
from tidemark.streaming.deadband import fill_grid
from tidemark.streaming.features import causal_features, score_windows_stream
from tidemark.streaming.spot import advance, calibrate, level, spot_batch, spot_stream

SPEC = SeriesSpec(("key",), ("t",), ("id",))


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(4)
    return {k: rng.exponential(1.0 + i, 700) for i, k in enumerate("ab")}


@pytest.fixture(scope="module")
def tables(spark, scores):
    rows = [(k, t, i * 1000 + t, float(v)) for i, (k, x) in enumerate(scores.items()) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key string, t long, id long, score double").cache()
    return df.filter("t < 400"), df.filter("t >= 400")


def plain_walk(calibration, values, rate=1e-3):
    """Straight walk over one key."""
    u = np.quantile(calibration, 0.98)
    tail = list(calibration[calibration > u] - u)
    n = len(calibration)

    def zq():
        m, v = np.mean(tail), np.var(tail, ddof=1)
        xi, sigma = 0.5 * (1 - m * m / v), 0.5 * m * (1 + m * m / v)
        return u + sigma / xi * ((rate * n / len(tail)) ** -xi - 1)

    z, out = zq(), []
    for s in values:
        out.append((z, int(s > z)))
        if s > z:
            continue
        n += 1
        if s > u:
            tail.append(s - u)
            z = zq()
    return out


def want(scores, rate):
    return {
        i * 1000 + 400 + j: pair
        for i, x in enumerate(scores.values())
        for j, pair in enumerate(plain_walk(x[:400], x[400:], rate))
    }


@pytest.mark.parametrize("limit", ["1000000", "60"])
@pytest.mark.parametrize("rate", [1e-3, 8e-3])
def test_batch_threshold_walk(spark, scores, tables, limit, rate):
    spark.conf.set("spark.tidemark.maxGroupRows", limit)
    try:
        got = spot_batch(tables[1], SPEC, calibrate(tables[0], ["key"], rate=rate), rate=rate).collect()
    finally:
        spark.conf.unset("spark.tidemark.maxGroupRows")
    expected = want(scores, rate)
    assert len(got) == len(expected) == 600
    for r in got:
        assert r["threshold"] == pytest.approx(expected[r["id"]][0], rel=1e-9)
        assert r["alarm"] == expected[r["id"]][1]
    assert sum(r["alarm"] for r in got) > 0 or rate == 1e-3


def test_alarm_is_not_absorbed():
    state = (1.0, 100.0, 3.0, 3.0, 4.0, 5.0)
    after, before, alarm = advance(state, 6.0, 1e-3)
    assert (after, before, alarm) == (state, 5.0, 1)
    after, before, alarm = advance(state, 2.0, 1e-3)
    assert before == 5.0 and alarm == 0 and after[1:3] == (101.0, 4.0)
    assert after[5] == pytest.approx(level(1.0, 101.0, 4.0, 4.0, 5.0, 1e-3))
    assert advance(state, 0.5, 1e-3)[0] == (1.0, 101.0, 3.0, 3.0, 4.0, 5.0)


def stream_of(spark, df, folder, parts):
    """Write the rows in time slices, one file each, and read them back in that order."""
    lo, hi = df.agg(F.min("t"), F.max("t")).first()
    edges = np.linspace(lo, hi + 1, parts + 1)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        df.filter((F.col("t") >= a) & (F.col("t") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def drain(spark, stream, folder):
    out = os.path.join(folder, "out")
    q = stream.writeStream.format("parquet").option("checkpointLocation", os.path.join(folder, "cp"))
    q.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_threshold_equals_batch(spark, tables, tmp_path, parts):
    start = calibrate(tables[0], ["key"], rate=8e-3)
    batch = {r["id"]: (r["threshold"], r["alarm"]) for r in spot_batch(tables[1], SPEC, start, rate=8e-3).collect()}
    stream = stream_of(spark, tables[1], str(tmp_path), parts)
    got = drain(spark, spot_stream(stream, ["key"], ["t"], ["id"], start, rate=8e-3), str(tmp_path)).collect()
    assert len(got) == 600
    for r in got:
        assert (r["threshold"], r["alarm"]) == (pytest.approx(batch[r["id"]][0], rel=1e-9), batch[r["id"]][1])


def test_stream_windows_and_features_over_micro_batches(spark, tables, tmp_path):
    rows = tables[1]
    pdf = rows.toPandas().sort_values(["key", "t"])
    stream = stream_of(spark, rows, str(tmp_path), 4)
    mean = lambda x: x.mean(axis=(1, 2))
    got = drain(spark, score_windows_stream(stream, ["key"], ["t"], ["id"], ["score"], 10, mean), str(tmp_path / "w"))
    roll = pdf.groupby("key")["score"].transform(lambda x: x.rolling(10).mean())
    expected = dict(zip(pdf["id"][roll.notna()], roll.dropna()))
    assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx(expected)
    made = drain(spark, causal_features(stream, ["key"], ["t"], ["id"], "score"), str(tmp_path / "f")).toPandas()
    merged = made.merge(
        pdf.assign(
            e=pdf.groupby("key")["score"].transform(lambda x: x.ewm(span=12, adjust=False).mean()),
            m=pdf.groupby("key")["score"].transform(lambda x: x.rolling(15, min_periods=1).median()),
        ),
        on=["key", "id"],
    )
    assert len(merged) == 600
    np.testing.assert_allclose(merged["score_ewma"], merged["e"], rtol=1e-9)
    np.testing.assert_allclose(merged["score_roll_median"], merged["m"], rtol=1e-9)


def test_deadband_fill(spark):
    df = spark.sql(
        "select * from values ('a', timestamp'2024-01-01 00:00:30', 1, 5.0), ('a', timestamp'2024-01-01 00:03:00', 2, 7.0) as v(key, ts, id, x)"
    )
    out = fill_grid(df, SeriesSpec(("key",), ("ts", "id"), ("id",)), ["x"], 60)
    got = [(str(r["grid_time"])[11:16], r["x"]) for r in out.orderBy("grid_time").collect()]
    assert [g[1] for g in got] == [5.0, 5.0, 7.0]
    assert [g[0][-2:] for g in got] == ["01", "02", "03"]


def test_injected_fault_shapes(spark):
    base = [("e", i, 10.0 + i, 1.0, 2.0, 3.0, 0.0, i % 256, 0, 0, "normal") for i in range(40)]
    df = spark.createDataFrame(
        base,
        "element_id string, step long, temperature double, pressure double, voltage double, current double, error_rate double, heartbeat int, quality_flag int, anomaly int, anomaly_type string",
    )
    eps = spark.createDataFrame(
        [
            ("e", 1, "communication_loss", "", 5, 10, 0.0),
            ("e", 2, "temperature_drift", "", 20, 25, 4.0),
            ("e", 3, "persistent_anomaly", "voltage", 24, 30, -1.0),
        ],
        "element_id string, episode int, kind string, channel string, start long, end long, size double",
    )
    out = {r["step"]: r for r in aug.inject(df, eps, ["element_id"], "step", ["element_id", "step"]).collect()}
    assert len(out) == 40
    assert [out[i]["temperature"] for i in range(5, 10)] == [14.0] * 5
    assert [out[i]["heartbeat"] for i in (4, 5, 9, 10)] == [4, 4, 4, 10]
    assert out[7]["quality_flag"] == 2 and out[7]["error_rate"] == pytest.approx(0.2)
    assert [out[i]["temperature"] - (10 + i) for i in range(20, 25)] == pytest.approx([0, 1, 2, 3, 4])
    assert out[24]["voltage"] == pytest.approx(1.85) and out[24]["anomaly_type"] == "persistent_anomaly"
    assert out[12]["anomaly"] == 0 and out[3]["temperature"] == 13.0


def test_faults_do_not_shuffle_rows_that_lie_by_series(spark, sf):
    from pyspark.sql import functions as F

    from tidemark.plans.ordered import with_position
    from workload.roles import TELEMETRY, telemetry
    from workload.tables import _episodes

    df = telemetry(spark, sf)
    placed = with_position(df, TELEMETRY, "pos").withColumn("step", F.col("pos") - 1).drop("pos")
    spark.conf.set("spark.tidemark.maxBroadcastRows", "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = aug.inject(placed, _episodes(df), ["element_id"], "step", ["element_id", "step"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        # the rows once for their positions, and the few episodes
        assert plan.count("Exchange hashpartitioning") == 2
        assert out.count() == df.count()
    finally:
        spark.conf.unset("spark.tidemark.maxBroadcastRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
