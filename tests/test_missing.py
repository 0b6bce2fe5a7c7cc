"""Missing values, vector lengths and quantiles: defined results and no lost rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casediff.operators import discretise
from casediff.operators.discretise import EqualFrequency, exact_quantiles
from casediff.operators.knn import DistanceSpec, broadcast_cases, knn_join
from casediff.operators.vdm import cvdhm_lookup, vdm_lookup
from casediff.plans.estimators import DifferenceRegressor
from casediff.plans.evaluate import cv_knn_scores
from casediff.plans.images import score_with_model

SCHEMA = "id bigint, x array<double>, y double"
NAN, INF = float("nan"), float("inf")


def brute(queries, cases, k, self_join=False):
    out = {}
    for i, q in queries:
        rows = []
        for j, c in cases:
            if self_join and i == j:
                continue
            width = max(len(v) for _, v in cases if v is not None)
            a, b = (np.array([np.nan] * width if v is None else [np.nan if w is None else w for w in v], dtype=float)
                    for v in (q, c))
            a[~np.isfinite(a)] = np.nan
            b[~np.isfinite(b)] = np.nan
            d = a - b
            d[np.isnan(d)] = 1.0
            rows.append((float((d * d).sum()), j))
        out[i] = [j for _, j in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_missing_features_on_both_sides_and_plans(spark, width):
    rng = np.random.default_rng(width)
    base = [[float(v) for v in rng.integers(-3, 4, width)] for _ in range(30)]
    cases = list(enumerate(base))
    for at, v in ((0, None), (7, [None] + base[7][1:]), (11, [NAN] + base[11][1:]), (15, [INF] + base[15][1:]), (29, None)):
        cases[at] = (at, v)
    queries = [(100 + i, v) for i, (_, v) in enumerate(cases)]
    c = spark.createDataFrame([(i, v, 0.0) for i, v in cases], SCHEMA)
    q = spark.createDataFrame([(i, v, 0.0) for i, v in queries], SCHEMA)
    want, want_self = brute(queries, cases, 4), brute(cases, cases, 4, True)
    for strategy, tile in (("broadcast", 200_000), ("tiles", 200_000), ("tiles", 7)):
        for got_of, w, self_join in ((q, want, False), (c, want_self, True)):
            n = knn_join(got_of, c, 4, exclude_self=self_join, strategy=strategy, tile_rows=tile)
            got = {r.query_id: r.ns for r in n.groupBy("query_id").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour_id"))), lambda s: s.neighbour_id)
                .alias("ns")).collect()}
            assert got == w, (strategy, tile, self_join)


def test_null_codes_are_the_unknown_value(spark):
    table = np.array([[0.0, 4.0, 9.0], [4.0, 0.0, 9.0], [9.0, 9.0, 9.0]])
    spec = DistanceSpec(tables=(table,))
    schema = "id bigint, x array<double>, codes array<int>"
    c = spark.createDataFrame([(1, [0.0], [0]), (2, [0.0], [1]), (3, [0.0], None), (4, [0.0], [None])], schema)
    q = spark.createDataFrame([(10, [0.0], [1])], schema)
    for strategy in ("broadcast", "tiles"):
        got = knn_join(q, c, 4, spec=spec, strategy=strategy).orderBy("rank").collect()
        assert [(r.neighbour_id, r.dist) for r in got] == [(2, 0.0), (1, 2.0), (3, 3.0), (4, 3.0)]


def test_overflowing_and_empty(spark):
    c = spark.createDataFrame([(1, [1e200] * 4, 0.0), (2, [0.0] * 4, 0.0)], SCHEMA)
    got = knn_join(c, c, 1, exclude_self=True).orderBy("query_id").collect()
    assert [(r.query_id, r.neighbour_id) for r in got] == [(1, 2), (2, 1)]
    for strategy in ("broadcast", "tiles"):
        assert knn_join(c, c.where("false"), 2, strategy=strategy).count() == 0
        assert knn_join(c.where("false"), c, 2, strategy=strategy).count() == 0


def test_lengths_that_differ_are_an_error(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0], 0.0)], SCHEMA)
    bad = spark.createDataFrame([(1, [1.0, 2.0], 0.0), (2, [1.0], 0.0)], SCHEMA)
    with pytest.raises(ValueError):
        knn_join(good, bad, 1)
    with pytest.raises(Exception, match="entries"):
        knn_join(bad, good, 1).collect()


def test_broadcast_bound_counts_carried_columns(spark):
    c = spark.range(100).select("id", F.array(F.lit(1.0)).alias("x"), F.lit(0.0).alias("y"),
                                F.array_repeat(F.lit(1), 1000).alias("px"))
    with pytest.raises(ValueError):
        broadcast_cases(c, carry=["px"], broadcast_bytes=100_000)
    broadcast_cases(c, broadcast_bytes=100_000).release()


@pytest.mark.parametrize("small", [100_000, 2])
def test_quantiles_equal_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(discretise, "SMALL", small)
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=1001), rng.integers(0, 3, 500).astype(float), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
        qs = [0, 0.1, 1 / 3, 0.5, 0.99, 1]
        assert np.allclose(exact_quantiles(df, "v", qs), np.quantile(values, qs), rtol=0, atol=1e-12)
    for rows in ([], [(None,)]):
        with pytest.raises(ValueError):
            EqualFrequency(3).fit(spark.createDataFrame(rows, "v double"), "v")


def test_value_distances_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(str(rng.integers(0, 6)), str(rng.integers(0, 3))) for _ in range(300)]
    df = spark.createDataFrame(rows, "f string, cls string")
    values, classes = sorted({v for v, _ in rows}), sorted({c for _, c in rows})
    n = np.array([[rows.count((v, c)) for c in classes] for v in values], dtype=float)
    vdm, cv = n / n.sum(1, keepdims=True), n / n.sum(0, keepdims=True)
    got_v = {(r.v1, r.v2): r.d for r in vdm_lookup(df, ["f"], "cls").collect()}
    got_c = {(r.v1, r.v2): r.d for r in cvdhm_lookup(df, ["f"], "cls").collect()}
    assert len(got_v) == len(got_c) == len(values) ** 2
    for i, a in enumerate(values):
        for j, b in enumerate(values):
            assert got_v[a, b] == pytest.approx(np.sqrt(((vdm[i] - vdm[j]) ** 2).sum()), abs=1e-9)
            assert got_c[a, b] == pytest.approx(np.abs(cv[i] - cv[j]).sum() / (cv[i] + cv[j]).sum(), abs=1e-9)


def test_cross_validation_plans_one_join(spark, capsys):
    c = spark.range(60).select("id", F.array((F.col("id") % 7).cast("double")).alias("x"), F.col("id").cast("double").alias("y"))
    cv_knn_scores(c, [1, 3], task="regression", weighted=False).explain()
    assert capsys.readouterr().out.count("MapInPandas") == 1


def test_models_release_what_they_hold(spark):
    c = spark.range(40).select("id", F.array(F.col("id").cast("double")).alias("x"), F.col("id").cast("double").alias("y"))
    held = lambda: len(spark.sparkContext._jsc.getPersistentRDDs())
    before = held()
    model = DifferenceRegressor(adapter="ols", kFit=2, kPredict=2).fit(c)
    assert model.predictions(c.limit(5)).count() == 5
    model.release()
    assert held() == before


def test_image_model_with_several_outputs(spark):
    class Softmax:
        def predict(self, x):
            dark = x.reshape(len(x), -1).mean(axis=1) > 5
            return np.stack([~dark, dark], axis=1).astype(float)

    pairs = spark.createDataFrame([(1, [0, 0, 0, 9]), (2, [9, 9, 9, 9])], "query_id bigint, diff array<int>")
    got = score_with_model(pairs, Softmax(), (2, 2, 1), outputs=[-3.0, 8.0]).orderBy("query_id").collect()
    assert [r.dhat for r in got] == [-3.0, 8.0]
    with pytest.raises(Exception, match="outputs"):
        score_with_model(pairs, Softmax(), (2, 2, 1)).collect()
