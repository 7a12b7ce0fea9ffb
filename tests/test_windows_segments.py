import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.segments import point_adjust, segment_table
from tidemark.operators.windows import (
    align_scores,
    map_windows,
    score_windows,
    scores_to_rows,
    sliding_windows,
    stable_row_id,
    stride_subset,
    temporal_split,
)
from tidemark.plans.ordered import running_sums, with_position
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(("s",), ("t",), ("id",))


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for s, n in (("a", 25), ("b", 9), ("c", 10), ("d", 61)):
        data += [(s, i, len(data) + i, float(i * i % 17), int(i % 7 in (2, 3))) for i in range(n)]
    data = [(s, t, k, v, y) for k, (s, t, _, v, y) in enumerate(data)]
    return spark.createDataFrame(data, "s string, t long, id long, v double, label int")


def collect(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_short_series_have_no_window(rows):
    w = sliding_windows(rows, SPEC, ["v"], 10)
    counts = {r["s"]: r["n"] for r in w.groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a": 16, "c": 1, "d": 52}


@pytest.mark.parametrize("stride", [1, 3, 4])
def test_strided_windows_are_a_subset_of_the_dense_ones(rows, stride):
    dense = stride_subset(sliding_windows(rows, SPEC, ["v"], 10), stride)
    direct = sliding_windows(rows, SPEC, ["v"], 10, stride)
    assert collect(dense, "id", "win") == collect(direct, "id", "win")


def test_chunked_window_scores_match_arrays(rows):
    arrays = sliding_windows(rows, SPEC, ["v"], 10)
    want = {r["id"]: sum(x[0] for x in r["win"]) for r in arrays.collect()}
    got = score_windows(rows, SPEC, ["v"], 10, lambda x: x.sum(axis=(1, 2)), chunk_rows=20)
    assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx(want)


def test_map_windows_with_stride(rows):
    got = map_windows(rows, SPEC, ["v"], 10, lambda x: {"m": x[:, :, 0]}, {"m": "array<double>"}, stride=3, chunk_rows=20)
    want = sliding_windows(rows, SPEC, ["v"], 10, 3)
    a = {r["id"]: r["m"] for r in got.collect()}
    b = {r["id"]: [x[0] for x in r["win"]] for r in want.collect()}
    assert a == b


def test_positions_splits_and_windows_agree_in_the_split_plan(spark, rows, split_plans):
    assert collect(with_position(rows, SPEC), "id", "_pos") == sorted((r["id"], r["t"] + 1) for r in rows.collect())
    train = temporal_split(rows, SPEC, 0.6).filter("is_train = 1").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in train} == {"a": 15, "b": 5, "c": 6, "d": 36}
    assert sliding_windows(rows, SPEC, ["v"], 10).count() == 69


def test_running_sums_without_keys_in_both_plans(spark, rows, split_plans):
    out = running_sums(rows, [], ["id"], {"c": F.col("v")}).orderBy("id").collect()
    assert [r["c"] for r in out] == pytest.approx(np.cumsum([r["v"] for r in out]).tolist())


def test_stable_row_id(rows):
    out = stable_row_id(rows, SPEC, "rid").orderBy("s", "t").collect()
    assert [r["rid"] for r in out] == list(range(len(out)))


@pytest.mark.parametrize("limit", ["1000000", "5"])
def test_point_adjust_and_segments(spark, limit):
    spark.conf.set("spark.tidemark.maxGroupRows", limit)
    try:
        data = [("a", i, i, y, p) for i, (y, p) in enumerate(zip([0, 1, 1, 0, 1], [0, 0, 1, 0, 0]))]
        # A run at the end of one series must not join a run at the start of the next.
        data += [("b", i, 5 + i, y, p) for i, (y, p) in enumerate(zip([1, 1, 0], [0, 1, 0]))]
        df = spark.createDataFrame(data, "s string, t long, id long, label int, predicted int")
        got = [r["adjusted"] for r in point_adjust(df, SPEC).orderBy("id").collect()]
        assert got == [0, 1, 1, 0, 0, 1, 1, 0]
        segs = collect(segment_table(df, SPEC), "s", "segment", "start", "end")
        assert segs == [("a", 1, 1, 3), ("a", 2, 4, 5), ("b", 1, 0, 2)]
    finally:
        spark.conf.unset("spark.tidemark.maxGroupRows")


def test_scores_back_to_rows(spark, rows):
    scores = sliding_windows(rows, SPEC, ["v"], 10).select("id", (F.col("win")[0][0] + 1).alias("score"))
    filled = scores_to_rows(rows, scores, ["id"])
    low = np.quantile([r["score"] for r in scores.collect()], 0.01)
    head = filled.filter("s = 'b'").collect()
    assert all(r["score"] == pytest.approx(low) for r in head)
    aligned = {r["id"]: r["score"] for r in align_scores(rows, scores, SPEC).filter("s = 'a'").collect()}
    assert [aligned[i] for i in range(9)] == [aligned[9]] * 9
