"""Differences (D), votes (A/B), adapters (L) and estimators (U) on hand-worked fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from casediff.operators import differences as D
from casediff.operators import vote as V
from casediff.operators.adapters import OlsAdapter, ZeroAdapter
from casediff.plans import learner as L
from casediff.plans.estimators import DifferenceClassifier, DifferenceRegressor
from conftest import cases


def pairs_df(spark, rows):
    """rows: (query_id, neighbour_id, rank, dist, n_y)."""
    return spark.createDataFrame(rows, "query_id long, neighbour_id long, rank int, dist double, n_y double")


def test_majority_vote_tie_goes_to_nearest(spark):
    p = pairs_df(spark, [(1, 10, 1, 0.5, 2.0), (1, 11, 2, 0.6, 1.0), (1, 12, 3, 0.7, 1.0),
                         (1, 13, 4, 0.8, 2.0)])
    assert V.majority_vote(p, F.col("n_y")).first()["prediction"] == 2.0


def test_knn_vote_tie_goes_to_smallest_label(spark):
    p = pairs_df(spark, [(1, 10, 1, 0.5, 2.0), (1, 11, 2, 0.6, 1.0)])
    assert V.knn_vote(p, F.col("n_y")).first()["prediction"] == 1.0


def test_weighted_vote_and_exact_match_takeover(spark):
    p = pairs_df(spark, [(1, 10, 1, 0.0, 3.0), (1, 11, 2, 0.1, 1.0), (1, 12, 3, 0.1, 1.0)])
    assert V.knn_weighted_vote(p, F.col("n_y")).first()["prediction"] == 3.0
    assert V.distance_weighted_mean(p, F.col("n_y")).first()["prediction"] == 3.0
    q = pairs_df(spark, [(1, 10, 1, 1.0, 3.0), (1, 11, 2, 0.5, 1.0), (1, 12, 3, 4.0, 1.0)])
    assert V.inverse_distance_vote(q, F.col("n_y")).first()["prediction"] == 1.0


def test_inverse_distance_mean(spark):
    p = pairs_df(spark, [(1, 10, 1, 1.0, 10.0), (1, 11, 2, 3.0, 20.0)])
    got = V.inverse_distance_mean(p, F.col("n_y")).first()["prediction"]
    w1, w2 = 1 / (1 + 1e-8), 1 / (3 + 1e-8)
    assert got == pytest.approx((w1 * 10 + w2 * 20) / (w1 + w2))


def _diffs(spark, dists):
    return spark.createDataFrame([(i, i + 100, 1, float(d)) for i, d in enumerate(dists)],
                                 "query_id long, neighbour_id long, rank int, dist double")


def test_duplication_far_pair_dropped_and_counts_stay_aligned(spark):
    # far pair gets count 0 and is dropped; the others keep their own count.
    d = [0.0, math.e - 1, math.e ** 2 - 1]          # ln(d+1) = 0, 1, 2
    w = {r["query_id"]: r["weight"] for r in D.with_duplication_weight(_diffs(spark, d)).collect()}
    assert w == {0: 10, 1: 5, 2: 0}
    copies = D.duplicate_by_distance(_diffs(spark, d)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in copies} == {0: 10, 1: 5}


def test_duplication_all_equal_distances_is_identity(spark):
    w = [r["weight"] for r in D.with_duplication_weight(_diffs(spark, [1.0, 1.0, 1.0])).collect()]
    assert w == [1, 1, 1]


def test_duplication_half_counts_round_to_even(spark):
    # l = 0, 0.75, 1 -> 10 - 7.5 = 2.5 -> 2 (half to even)
    d = [0.0, math.exp(0.75) - 1, math.e - 1]
    w = {r["query_id"]: r["weight"] for r in D.with_duplication_weight(_diffs(spark, d)).collect()}
    assert w[1] == 2


def test_combo_layout_is_the_same_in_fit_and_predict(spark):
    tr = cases(spark, [(1, [0.0, 1.0], 1.0), (2, [1.0, 1.0], 2.0), (3, [3.0, 0.0], 5.0)])
    v = L.Variant(context=True, duplicate=True, distance_column=True)
    diffs = L.training_differences(tr, 1, v)
    row = diffs.where("query_id = 1").first()
    # interleave([dx1, dx2], [x1, x2]) ++ [dist]
    assert row["features"] == [-1.0, 0.0, 0.0, 1.0, 1.0]
    te = cases(spark, [(9, [0.0, 0.0], 0.0)])
    a = L.fit_adapter(diffs, ZeroAdapter(), v)
    scored = L.scored_query_pairs(te, tr, 1, a, v).first()
    assert scored["features"] == [-0.0, 0.0, -1.0, 0.0, 1.0]


def test_zero_adapter_reduces_to_knn_mean(spark):
    tr = cases(spark, [(i, [float(i)], float(i * i)) for i in range(10)])
    te = cases(spark, [(100, [2.2], 0.0), (101, [7.6], 0.0)])
    a = L.fit_predict(tr, te, task="regression", adapter=ZeroAdapter(), weighted=False, k_predict=3)
    b = L.knn_baseline(tr, te, 3, task="regression", weighted=False)
    assert sorted(a.collect()) == sorted(b.collect())


def test_ols_adapter_recovers_linear_relation(spark):
    tr = cases(spark, [(i, [float(i)], 3.0 * i + 1.0) for i in range(20)])
    a = L.fit_adapter(L.training_differences(tr, 3), OlsAdapter(0))
    assert a.slope == pytest.approx(3.0) and a.intercept == pytest.approx(0.0, abs=1e-9)
    te = cases(spark, [(100, [4.5], 0.0)])
    model = DifferenceRegressor(adapter="ols").fit(tr)
    assert model.predictions(te).first()["prediction"] == pytest.approx(3.0 * 4.5 + 1.0)


def test_set_params_maps_reference_names_and_rejects_unknown():
    est = DifferenceRegressor().set_params(n_neighbours_1=3, n_neighbours_2=7, weighted_knn=False,
                                           additional_distance_column=True)
    p = est.get_params()
    assert (p["kFit"], p["kPredict"], p["weighted"], p["distanceColumn"]) == (3, 7, False, True)
    with pytest.raises(ValueError):
        est.set_params(additional_results_colum=True)
    c = est.copy()
    assert c.get_params()["kFit"] == 3
    assert DifferenceClassifier().get_params()["weighted"] is False


def test_classifier_mode_adapter(spark):
    tr = cases(spark, [(i, [float(i)], float(i // 5)) for i in range(20)])
    te = cases(spark, [(100, [1.0], 0.0), (101, [17.0], 0.0)])
    m = DifferenceClassifier(adapter="mode").fit(tr)
    pred = {r["id"]: r["prediction"] for r in m.predictions(te).collect()}
    assert pred == {100: 0.0, 101: 3.0}


def test_ols_constant_feature_fits_the_mean_difference(spark):
    # Every neighbour has the same x: the difference feature is constant 0, so the
    # least-squares fit is slope 0 and intercept mean(dy).
    diffs = spark.createDataFrame([([0.0], 1.0), ([0.0], 3.0)], "features array<double>, dy double")
    a = OlsAdapter(0).fit(diffs)
    assert (a.slope, a.intercept) == (0.0, 2.0)


def test_checkpointed_case_base_predicts_the_same(spark):
    tr = cases(spark, [(i, [float(i)], 2.0 * i) for i in range(15)])
    te = cases(spark, [(100, [3.5], 0.0)])
    a = DifferenceRegressor(adapter="ols").fit(tr).predictions(te).first()["prediction"]
    b = DifferenceRegressor(adapter="ols", checkpointCases=True).fit(tr).predictions(te).first()["prediction"]
    assert a == pytest.approx(b)
