import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import ensembles as en
from tidemark.operators import evaluation as ev
from tidemark.operators import thresholds as th
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(("s",), ("t",), ("id",))
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def table(spark, scores, labels, model="m"):
    rows = [(model, "a", i, i, float(x), int(y)) for i, (x, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "model string, s string, t long, id long, score double, label int")


def brute_threshold(scores, labels):
    """Rate every distinct score as a cut; the highest of the best wins."""
    scores, labels = np.array(scores, float), np.array(labels)
    n, best = len(scores), None
    if labels.sum() == 0:
        return scores.max()
    for t in sorted(set(scores), reverse=True):
        k = int((scores >= t).sum())
        if k <= max(1, n // 2):
            f1 = 2 * labels[scores >= t].sum() / (k + labels.sum())
            if best is None or f1 > best[0]:
                best = (f1, t)
    return best[1] if best else scores.max()


@QUICK
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), min_size=1, max_size=30))
def test_best_threshold_is_exact(spark, pairs):
    scores, labels = [p[0] for p in pairs], [p[1] for p in pairs]
    got = th.best_threshold(th.score_cuts(table(spark, scores, labels), ["model"]), ["model"]).first()["threshold"]
    assert got == brute_threshold(scores, labels)


@pytest.mark.parametrize(
    "scores,labels",
    [([1, 1, 1, 1], [1, 0, 1, 0]), ([3, 2, 1], [0, 0, 0]), ([3, 2, 1, 0], [1, 1, 1, 1]), ([5], [1])],
)
def test_threshold_edge_cases(spark, scores, labels):
    got = th.best_threshold(th.score_cuts(table(spark, scores, labels), []), []).first()["threshold"]
    assert got == brute_threshold(scores, labels)


def test_auc_flips_with_the_sign_and_counts_ties_half(spark):
    rng = np.random.default_rng(3)
    scores, labels = rng.integers(0, 9, 200), rng.integers(0, 2, 200)
    up = ev.ranking_metrics(th.score_cuts(table(spark, scores, labels), []), []).first()
    down = ev.ranking_metrics(th.score_cuts(table(spark, -scores, labels), []), []).first()
    pos, neg = scores[labels == 1], scores[labels == 0]
    pairs = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert up["roc_auc"] == pytest.approx(pairs)
    assert down["roc_auc"] == pytest.approx(1 - pairs)


def test_single_class_has_no_auc(spark):
    row = ev.ranking_metrics(th.score_cuts(table(spark, [1, 2], [1, 1]), []), []).first()
    assert row["roc_auc"] is None and row["pr_auc"] == pytest.approx(1.0)


def test_point_adjust_never_lowers_the_rates(spark):
    rng = np.random.default_rng(5)
    df = table(spark, rng.normal(size=300), (np.sin(np.arange(300) / 6) > 0.8).astype(int))
    row = ev.compute_metrics(df, SPEC, ["model"]).first()
    assert row["pa_f1"] >= row["f1"]
    assert row["tp"] + row["fp"] + row["fn"] + row["tn"] == 300


def test_optimum_is_at_least_any_swept_threshold(spark):
    rng = np.random.default_rng(6)
    df = table(spark, rng.normal(size=400), rng.random(400) < 0.1)
    swept = th.sweep_threshold(df, ["model"]).first()["f1"]
    assert ev.compute_metrics(df, SPEC, ["model"]).first()["f1"] >= swept - 1e-12


@pytest.mark.parametrize("limit", ["1000000", "7"])
def test_quantiles_in_both_plans(spark, limit):
    spark.conf.set("spark.tidemark.maxGroupRows", limit)
    try:
        rng = np.random.default_rng(7)
        values = np.concatenate([rng.normal(size=90), np.zeros(40)])
        df = table(spark, values, np.zeros(130))
        probs = [0.0, 0.01, 0.33, 0.5, 0.98, 1.0]
        got = {r["prob"]: r["quantile"] for r in th.exact_quantiles(df, ["model"], "score", probs).collect()}
        assert [got[p] for p in probs] == pytest.approx(np.quantile(values, probs).tolist())
    finally:
        spark.conf.unset("spark.tidemark.maxGroupRows")


def test_tail_by_moments_and_zero_shape(spark):
    u, xi, sigma, n, nt = (F.lit(float(v)) for v in (1.0, 0.0, 2.0, 1000, 20))
    flat = spark.range(1).select(th.tail_level(u, xi, sigma, n, nt).alias("z")).first()["z"]
    assert flat == pytest.approx(1.0 + 2.0 * np.log(20 / (1e-3 * 1000)))
    near = spark.range(1).select(th.tail_level(u, F.lit(1e-5), sigma, n, nt).alias("z")).first()["z"]
    assert near == pytest.approx(flat, rel=1e-3)


def test_tail_by_likelihood_finds_the_maximum(spark):
    rng = np.random.default_rng(8)
    xi, sigma = 0.2, 1.5
    excess = sigma / xi * ((1 - rng.random(4000)) ** (-xi) - 1)
    df = table(spark, excess, np.zeros(4000))
    moments = spark.createDataFrame([("m", 0.0)], "model string, u double")
    row = th.fit_tail_by_likelihood(df, moments, ["model"], "score").first()

    def loglik(x, s):
        return -len(excess) * np.log(s) - (1 / x + 1) * np.log1p(x * excess / s).sum()

    best = loglik(row["xi"], row["sigma"])
    assert row["xi"] == pytest.approx(xi, abs=0.08) and row["sigma"] == pytest.approx(sigma, rel=0.08)
    for dx, ds in ((0.01, 0), (-0.01, 0), (0, 0.02), (0, -0.02)):
        assert best >= loglik(row["xi"] + dx, row["sigma"] + ds)


@pytest.fixture(scope="module")
def votes(spark):
    rows = spark.createDataFrame(
        [(i, int(i < 6), "k" if i < 6 else "normal", int(i % 2)) for i in range(10)],
        "row_id long, anomaly int, anomaly_type string, alarm int",
    )
    flags = {"a": [0, 1, 2, 7], "b": [2, 3], "c": [0, 1, 2, 3], "d": [9]}
    preds = [(m, i, int(i in hit)) for m, hit in flags.items() for i in range(9)] + [("d", 9, 1)]
    return spark.createDataFrame(preds, "model string, row_id long, predicted int"), rows


def test_majority_of_even_members_needs_half(votes):
    preds, rows = votes
    v = en.votes(preds, rows.select("row_id"), {"four": ("a", "b", "c", "d"), "three": ("a", "b", "c")})
    got = {r["row_id"]: (r["m4"], r["m3"]) for r in v.select(
        "row_id", en.majority_flag("four", 4).alias("m4"), en.majority_flag("three", 3).alias("m3")).collect()}
    assert got[0] == (1, 1) and got[3] == (1, 1) and got[7] == (0, 0) and got[9] == (0, 0)


def test_greedy_cover_stops_after_the_first_useless_model(votes):
    preds, rows = votes
    got = [tuple(r) for r in en.greedy_cover(preds, rows, ["a", "b", "c", "d"]).orderBy("rank").collect()]
    assert got == [(1, "c", 4, pytest.approx(4 / 6)), (2, "a", 0, pytest.approx(4 / 6))]


def test_agreement_matches_numpy_and_nulls_constant_vectors(votes):
    preds, rows = votes
    got = {(r[0], r[1]): r[2] for r in en.agreement(preds, rows, ["a", "b", "d"]).collect()}
    a, b = [1, 1, 1, 0, 0, 0], [0, 0, 1, 1, 0, 0]
    assert got[("a", "b")] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert got[("a", "d")] is None


@pytest.mark.parametrize("xi", [0.0, 0.3, 0.9, 1.3, 2.0])
def test_tail_likelihood_reaches_its_optimum(spark, xi):
    rng = np.random.default_rng(11)
    u = rng.random(20_000)
    x = -np.log(u) if xi == 0 else (u**-xi - 1) / xi
    df = spark.createDataFrame([(float(v),) for v in x], "score double")
    found = th.pot_threshold(df, [], method="likelihood").first()
    tail = x[x > found["u"]] - found["u"]

    def level(theta):
        shape = np.log1p(-theta * tail).mean()
        return -np.log(-shape / theta) - shape - 1

    grid = -np.geomspace(1e-9 / tail.max(), 1e3 / tail.min(), 20_000)
    best = max(level(t) for t in [*grid, *np.linspace(1e-6, 0.999, 2_000) / tail.max()] if -np.log1p(-t * tail).mean() / t > 0)
    own = -found["xi"] / found["sigma"]
    assert level(own) >= best - 1e-6
