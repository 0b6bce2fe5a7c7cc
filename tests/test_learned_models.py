"""Linear and tree adapters, tuning, positions, and models that are saved and loaded."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from casediff.operators.adapters import LinearAdapter, ModeAdapter, OlsAdapter, TreeAdapter
from casediff.operators.knn import DistanceSpec
from casediff.operators.sampling import number_within, random_cases, stratified_folds
from casediff.plans import evaluate as E
from casediff.plans import images as IM
from casediff.plans import learner as L
from casediff.plans.estimators import DifferenceClassifier, DifferenceModel, DifferenceRegressor
from casediff.plans.implicit_estimators import (
    ImageClassifier,
    ImageLearnerModel,
    ImplicitClassifier,
    ImplicitLearnerModel,
    ImplicitRegressor,
)
from casediff.session import scratch_path

ROWS = "id bigint, x array<double>, y double"


def cases(spark, n=200, dim=3, seed=1, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    y = np.floor((x[:, 0] > 0) + (x[:, 1] > 0.3) * (labels - 2)).astype(float)
    return spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)], ROWS).repartition(4)


def test_linear_adapter_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    x[:, 5] = x[:, 4]  # collinear
    y, w = x @ rng.normal(size=12) + 2 + rng.normal(size=300), rng.integers(0, 4, 300)
    df = spark.createDataFrame([(list(map(float, a)), float(b), int(c)) for a, b, c in zip(x, y, w, strict=True)],
                               "features array<double>, dy double, w int").repartition(7)
    for weight in (None, "w"):
        a = LinearAdapter(reg=0.01).fit(df, weight=weight)
        ww = np.ones(300) if weight is None else w
        xx = np.column_stack([x, np.ones(300)])
        g = (xx * ww[:, None]).T @ xx / ww.sum() + np.diag([0.01] * 12 + [0])
        want = np.linalg.solve(g, (xx * ww[:, None]).T @ y / ww.sum())
        assert np.allclose([*a.coef, a.intercept], want)
    got = a.score(df).orderBy("dy").collect()
    assert np.allclose([r.dhat for r in got], [np.dot(r.features, a.coef) + a.intercept for r in got])


def test_linear_adapter_odd_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), (None, 1.0), ([None, 1.0], 2.0), ([1.0, float("nan")], 2.0), ([3.0, 4.0], None),
                                ([2.0, 1.0], 3.0)], "features array<double>, dy double")
    a = LinearAdapter().fit(df)
    b = LinearAdapter().fit(df.where("dy in (1.0, 3.0) and features is not null"))
    assert np.allclose(a.coef, b.coef)
    assert LinearAdapter().fit(df.where("false")).score(df).first().dhat == 0.0
    with pytest.raises(ValueError, match="1 to 2"):
        LinearAdapter().fit(spark.createDataFrame([([1.0], 1.0), ([1.0, 2.0], 1.0)], "features array<double>, dy double"))
    with pytest.raises(ValueError, match="3000 features"):
        LinearAdapter().fit(spark.createDataFrame([([1.0] * 3000, 1.0)], "features array<double>, dy double"))


def plain_tree(rows, depth, bins):
    """Greedy splits by plain counting: {node: (f, b)}, {node: label}, ranges."""
    lo = [min(x[f] for x, _ in rows) for f in range(len(rows[0][0]))]
    hi = [max(x[f] for x, _ in rows) for f in range(len(rows[0][0]))]

    def bin_of(v, f):
        return max(0, min(bins - 1, int(np.floor((v - lo[f]) * bins / (hi[f] - lo[f]))))) if hi[f] > lo[f] else 0

    splits, labels = {}, {}

    def grow(node, part, level):
        best = None
        total = sum(n * n for n in Counter(y for _, y in part).values()) / len(part)
        for f in range(len(lo)) if level < depth else ():
            for b in range(1, bins):
                left, right = ([y for x, y in part if (bin_of(x[f], f) < b) == side] for side in (True, False))
                if left and right:
                    purity = sum(sum(n * n for n in Counter(s).values()) / len(s) for s in (left, right))
                    if purity > total + 1e-9 and (best is None or purity > best[0]):
                        best = (purity, f, b)
        if best is None:
            labels[node] = min(Counter(y for _, y in part).items(), key=lambda t: (-t[1], t[0]))[0]
            return
        _, f, b = best
        splits[node] = (f, b)
        grow(2 * node, [r for r in part if bin_of(r[0][f], f) < b], level + 1)
        grow(2 * node + 1, [r for r in part if bin_of(r[0][f], f) >= b], level + 1)

    grow(1, rows, 0)

    def predict(x):
        node = 1
        while node in splits:
            f, b = splits[node]
            node = 2 * node + (bin_of(x[f], f) >= b)
        return labels[node]

    return predict


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_tree_equals_plain_counting(spark, depth):
    rows = [(r.x, r.y) for r in cases(spark).collect()]
    predict = plain_tree(rows, depth, 8)
    df = spark.createDataFrame([(x, y) for x, y in rows], "features array<double>, dy double")
    a = TreeAdapter(depth=depth, bins=8).fit(df)
    assert all(r.dhat == predict(r.features) for r in a.score(df).collect())
    far = spark.createDataFrame([([99.0, -99.0, 0.0],), ([-99.0, 99.0, None],)], "features array<double>")
    assert a.score(far).count() == 2


def test_trees_of_many_groups_in_one_fit(spark):
    rng = random.Random(4)
    rows = [(g, [rng.random(), rng.random()], float(rng.randrange(3))) for g in [*"abc", None] for _ in range(40)]
    df = spark.createDataFrame(rows, "g string, features array<double>, dy double")
    a = TreeAdapter(depth=2, bins=4, group="g").fit(df)
    got = a.score(df).collect()
    assert len(got) == len(rows) and a.table.count() == 4
    assert {r.g for r in got} == {"a", "b", "c", None}
    assert a.score(spark.createDataFrame([("zz", [0.5, 0.5])], "g string, features array<double>")).count() == 0


def test_learner_tuning_equals_a_loop_over_folds(spark):
    """Every fold left out in turn, fitted and scored by the learner itself."""
    c = spark.createDataFrame([(i, [float((i * 7919) % 101), float(i % 3)], float((i * i) % 97)) for i in range(90)], ROWS)
    got = {(r.k_fit, r.k_predict, r.flag, r.weighted): r.score for r in E.cv_learner_scores(c, (1, 3), (2, 4), n_folds=3).collect()}
    assert len(got) == 2 * 2 * 3 * 2
    folded = E.with_folds(c, 3).cache()
    variants = {"plain": (L.Variant(), 0), "context": (L.Variant(context=True), 1), "distance": (L.Variant(distance_column=True), -1)}
    for flag, k_fit, k_predict, weighted in (("plain", 3, 4, True), ("context", 1, 2, False), ("distance", 3, 2, True)):
        variant, index = variants[flag]
        scores = []
        for v in range(3):
            train, test = folded.where(f"fold <> {v}").drop("fold"), folded.where(f"fold = {v}").drop("fold")
            p = L.fit_predict(train, test, task="regression", adapter=OlsAdapter(index), k_fit=k_fit, k_predict=k_predict,
                              weighted=weighted, variant=variant)
            truth = {r.id: r.y for r in test.collect()}
            scores.append(-np.mean([abs(r.prediction - truth[r.query_id]) for r in p.collect()]))
        assert abs(np.mean(scores) - got[k_fit, k_predict, flag, weighted]) < 1e-6


def test_positions_folds_and_random_cases(spark):
    rows = [(i, [0.0], "a" if i % 3 else None) for i in range(1000)] + [(5000, [0.0], "b")]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, cls string").repartition(5)
    by = defaultdict(list)
    for r in number_within(df, "cls", seed=3).collect():
        by[r.cls].append((r.pos, r.n_pos))
    assert {k: sorted(p for p, _ in v) for k, v in by.items()} == {
        "a": list(range(666)), None: list(range(334)), "b": [0]} and {n for _, n in by["a"]} == {666}
    folds = Counter((r.cls, r.fold) for r in stratified_folds(df, "cls", 10).collect())
    assert set(folds[("a", f)] for f in range(10)) <= {66, 67} and sum(folds.values()) == 1001
    q = df.where("id < 40").select("id", "x")
    got = defaultdict(list)
    for r in random_cases(q, df, 5, "cls", seed=2).collect():
        got[r.query_id, r.cls].append((r["rank"], r.neighbour_id))
    assert len(got) == 40 * 3
    for (_, cls), some in got.items():
        assert len({n for _, n in some}) == len(some) == (1 if cls == "b" else 5)
        assert sorted(k for k, _ in some) == list(range(1, len(some) + 1))
    assert len({tuple(sorted(n for _, n in some)) for (_, cls), some in got.items() if cls == "a"}) > 30


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("adapter", ["ols", "linear", "zero"])
def test_difference_models_are_saved_and_loaded(spark, adapter):
    c = cases(spark)
    model = DifferenceRegressor(adapter=adapter, kPredict=3, distanceColumn=True).fit(c)
    path = scratch_path(spark, "model")
    model.save(path)
    again = DifferenceModel.load(spark, path)
    assert again.getOrDefault(again.kPredict) == 3 and same(model.predictions(c), again.predictions(c))


def test_classifier_with_metric_trees_and_clamp(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random()], [i % 3], float(rng.choice([0, 1, 4]))) for i in range(150)]
    c = spark.createDataFrame(rows, "id bigint, x array<double>, codes array<int>, y double")
    spec = DistanceSpec(numeric="clip", tables=(np.array([[0.0, 0.4, 1.0, 1.0], [0.4, 0.0, 0.2, 1.0], [1.0, 0.2, 0.0, 1.0], [1.0] * 4]),))
    model = DifferenceClassifier(adapter=TreeAdapter(depth=3), spec=spec, clampToKnown=True).fit(c)
    path = scratch_path(spark, "model")
    model.save(path)
    again = DifferenceModel.load(spark, path)
    assert same(model.predictions(c), again.predictions(c))
    assert {r.prediction for r in model.predictions(c).collect()} <= {0.0, 1.0, 4.0}
    clamped = L.clamp_to_known(spark.createDataFrame([(1, -3.0), (2, 2.5), (3, 2.6), (4, 9.0), (5, 1.0)], "query_id int, prediction double"),
                               c.select("y"))
    assert {r.query_id: r.prediction for r in clamped.collect()} == {1: 0.0, 2: 1.0, 3: 4.0, 4: 4.0, 5: 1.0}


@pytest.mark.parametrize("kw", [{"adapter": "mode"}, {"adapter": "tree", "depth": 1}, {"randomPairs": True, "seed": 5}, {"singlePair": True}])
def test_implicit_models_are_saved_and_loaded(spark, kw):
    c = cases(spark, 120)
    for est in (ImplicitClassifier(nNeighbours=2, **kw), ImplicitRegressor(nNeighbours=2, nSegments=2, **kw)):
        model = est.fit(c)
        path = scratch_path(spark, "model")
        model.save(path)
        again = ImplicitLearnerModel.load(spark, path)
        assert again.get_params() == model.get_params() and same(model.predictions(c), again.predictions(c))
    with pytest.raises(ValueError, match="unknown parameter"):
        ImplicitClassifier(nope=1)


def test_image_model_is_saved_and_trained(spark):
    rng = random.Random(1)
    c = spark.createDataFrame([(i, [rng.randrange(256) for _ in range(4)], i % 2) for i in range(40)], "id bigint, px array<int>, y int")
    seen = []
    model = ImageClassifier(shape=(2, 2, 1), train=lambda diffs: (seen.append(diffs.count()), IM.PixelBandModel())[1], kFit=3).fit(c)
    assert seen == [120]
    path = scratch_path(spark, "model")
    model.save(path)
    assert same(model.predictions(c), ImageLearnerModel.load(spark, path, IM.PixelBandModel()).predictions(c))


def test_mode_adapter_still_saves(spark):
    c = cases(spark, 60)
    model = DifferenceClassifier(adapter=ModeAdapter()).fit(c)
    path = scratch_path(spark, "model")
    model.save(path)
    assert same(model.predictions(c), DifferenceModel.load(spark, path).predictions(c))
