"""Implicit learner (U3) and stream scoring."""

import os
import tempfile

from pyspark.sql import functions as F

from casediff.plans import implicit as I
from casediff.plans.estimators import DifferenceRegressor
from casediff.streaming import score_stream
from conftest import cases


def test_implicit_pairs_use_retrieved_case_class(spark):
    # 1 and 2 are mutual nearest; 3's nearest is 2.  Pairs are [retrieved : base],
    # filed under the retrieved case's class (X11).
    tr = cases(spark, [(1, [0.0], 0), (2, [1.0], 1), (3, [3.0], 1)])
    pairs = {(r["src_id"], r["target_id"]): (r["src_class"], r["pair"], r["label"])
             for r in I.case_pairs(tr).collect()}
    assert pairs[(2, 1)] == (1.0, [1.0, 0.0], 0.0)
    assert pairs[(2, 3)] == (1.0, [1.0, 3.0], 1.0)
    pools = {r["id"] for r in I.class_pools(tr, I.case_pairs(tr)).collect()}
    assert pools == {1, 2}


def test_implicit_vote_with_mode_adapter(spark):
    tr = cases(spark, [(i, [float(i)], float(i // 4)) for i in range(12)])
    m = I.fit_implicit(tr, n_neighbours=2)
    te = cases(spark, [(100, [0.5], 0.0), (101, [10.5], 0.0)])
    pred = {r["query_id"]: r["prediction"] for r in m.predict(te).collect()}
    assert set(pred) == {100, 101}


def test_stream_scoring_matches_batch(spark):
    tr = cases(spark, [(i, [float(i)], 2.0 * i) for i in range(30)])
    model = DifferenceRegressor(adapter="ols").fit(tr)
    root = tempfile.mkdtemp(prefix="casediff-stream-")
    src = os.path.join(root, "in")
    te = cases(spark, [(100 + i, [i + 0.5], 0.0) for i in range(5)])
    te.select("id", "x").write.parquet(src)
    stream = spark.readStream.schema(te.select("id", "x").schema).parquet(src)
    q = score_stream(stream, model, os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    got = {r["id"]: r["prediction"] for r in spark.read.parquet(os.path.join(root, "out")).collect()}
    want = {r["id"]: r["prediction"] for r in model.predictions(te).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_broadcast_once_case_base_gives_the_same_predictions(spark):
    tr = cases(spark, [(i, [float(i), float(i % 3)], 2.0 * i) for i in range(25)])
    te = cases(spark, [(100 + i, [i + 0.3, 1.0], 0.0) for i in range(6)])
    model = DifferenceRegressor(adapter="ols").fit(tr)
    want = {r["id"]: r["prediction"] for r in model.predictions(te).collect()}
    model.broadcast_case_base()
    got = {r["id"]: r["prediction"] for r in model.predictions(te).collect()}
    assert got == want
