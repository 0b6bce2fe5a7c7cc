"""kNN join (K1-K6): brute-force equivalence, ties, twins, properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from casediff.operators.knn import knn_join, random_order, self_knn
from conftest import cases


def brute(q_ids, qx, c_ids, cx, k, exclude_self=False, groups=None, qgroups=None):
    out = {}
    for i, qid in enumerate(q_ids):
        d2 = ((cx - qx[i]) ** 2).sum(axis=1)
        ok = np.ones(len(c_ids), bool)
        if exclude_self:
            ok &= c_ids != qid
        if groups is not None:
            ok &= groups != qgroups[i]
        idx = np.flatnonzero(ok)
        order = idx[np.lexsort((c_ids[idx], np.round(d2[idx], 9)))][:k]
        out[int(qid)] = [int(c) for c in c_ids[order]]
    return out


def got(df):
    r = {}
    for row in df.orderBy("query_id", "rank").collect():
        r.setdefault(row["query_id"], []).append(row["neighbour_id"])
    return r


@pytest.fixture(scope="module")
def random_cases(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(120, 5)), 1)      # rounding makes ties common
    rows = [(i * 7 + 1, x[i], i % 4) for i in range(120)]
    return cases(spark, rows), np.array([r[0] for r in rows]), x


@pytest.mark.parametrize("strategy,tile_rows", [("broadcast", 20000), ("tiles", 20000), ("tiles", 16)])
def test_self_knn_matches_brute_force(spark, random_cases, strategy, tile_rows):
    df, ids, x = random_cases
    res = got(self_knn(df, 4, strategy=strategy, tile_rows=tile_rows))
    assert res == brute(ids, x, ids, x, 4, exclude_self=True)


def test_query_knn_high_dim_blas_path(spark):
    rng = np.random.default_rng(5)
    cx = rng.normal(size=(90, 40)) * 1000.0     # large norms: tolerance must scale
    qx = cx[:20] + rng.normal(size=(20, 40)) * 1e-3
    c = cases(spark, [(i, cx[i], 0) for i in range(90)])
    q = cases(spark, [(1000 + i, qx[i], 0) for i in range(20)])
    for strategy in ("broadcast", "tiles"):
        res = got(knn_join(q, c, 3, strategy=strategy, tile_rows=25))
        assert res == brute(np.arange(1000, 1020), qx, np.arange(90), cx, 3)


def test_k1_row_count_is_min_k_n_minus_1(spark):
    df = cases(spark, [(i, [float(i)], 0) for i in range(4)])
    nb = self_knn(df, 10)
    counts = {r["query_id"]: r["n"] for r in nb.groupBy("query_id").count()
              .withColumnRenamed("count", "n").collect()}
    assert counts == {0: 3, 1: 3, 2: 3, 3: 3}


def test_twins_excluded_by_id_not_by_position(spark):
    # Two cases with the same x: each is the other's nearest at distance 0.
    df = cases(spark, [(1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2), (3, [5.0, 5.0], 3)])
    nb = self_knn(df, 1).collect()
    pairs = {(r["query_id"], r["neighbour_id"], r["dist"]) for r in nb}
    assert (1, 2, 0.0) in pairs and (2, 1, 0.0) in pairs


def test_ties_break_by_neighbour_id(spark):
    q = cases(spark, [(100, [0.0], 0)])
    c = cases(spark, [(9, [1.0], 0), (3, [-1.0], 0), (5, [1.0], 0), (7, [2.0], 0)])
    nb = knn_join(q, c, 3).orderBy("rank").collect()
    assert [r["neighbour_id"] for r in nb] == [3, 5, 9]
    assert [r["rank"] for r in nb] == [1, 2, 3]


def test_invariant_under_repartition(spark, random_cases):
    df, _, _ = random_cases
    a = got(self_knn(df, 3))
    b = got(self_knn(df.repartition(7), 3, strategy="tiles", tile_rows=30))
    assert a == b


def test_per_class_top_n_and_short_class(spark):
    # Class "b" has fewer rows than N: fewer neighbours, no failure.
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()),
                           T.StructField("x", T.ArrayType(T.DoubleType())),
                           T.StructField("cls", T.StringType())])
    c = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "a"), (3, [2.0], "a"),
                               (4, [0.5], "b")], schema)
    q = cases(spark, [(10, [0.1], 0)])
    nb = knn_join(q, c, 2, by="cls").collect()
    per = {}
    for r in nb:
        per.setdefault(r["cls"], []).append((r["rank"], r["neighbour_id"]))
    assert sorted(per["a"]) == [(1, 1), (2, 2)]
    assert sorted(per["b"]) == [(1, 4)]


def test_exclude_group_gives_other_folds_only(spark, random_cases):
    df, ids, x = random_cases
    folded = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    res = got(knn_join(folded, folded, 3, exclude_self=True, exclude_group="fold"))
    g = ids % 3
    assert res == brute(ids, x, ids, x, 3, exclude_self=True, groups=g, qgroups=g)


def test_random_order_is_seeded_and_per_query(spark):
    c = cases(spark, [(i, [0.0], 0) for i in range(50)])
    q = cases(spark, [(1000, [0.0], 0), (1001, [0.0], 0)])
    a = got(knn_join(q, c, 5, spec=random_order(7)))
    b = got(knn_join(q, c, 5, spec=random_order(7), strategy="tiles", tile_rows=10))
    assert a == b
    assert a[1000] != a[1001]
    assert all(len(set(v)) == 5 for v in a.values())


def test_match_group_restricts_to_same_group(spark, random_cases):
    df, ids, x = random_cases
    grouped = df.withColumn("g", (F.col("id") % 2).cast("int"))
    res = got(knn_join(grouped, grouped, 2, exclude_self=True, match_group="g"))
    for qid, nbrs in res.items():
        assert all(n % 2 == qid % 2 for n in nbrs)
    g = ids % 2
    for qid, nbrs in res.items():
        i = list(ids).index(qid)
        same = np.flatnonzero((g == g[i]) & (ids != qid))
        d2 = ((x[same] - x[i]) ** 2).sum(1)
        want = ids[same][np.lexsort((ids[same], np.round(d2, 9)))][:2]
        assert nbrs == [int(v) for v in want]


def test_tiled_plan_pins_one_partition_per_tile(spark, random_cases):
    # AQE coalesces shuffles by bytes; kNN tiles are small in bytes but heavy in
    # compute, so their exchanges must be explicit (REPARTITION_BY_NUM).
    df, _, _ = random_cases
    out = self_knn(df, 3, strategy="tiles", tile_rows=30)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    assert plan.count("REPARTITION_BY_NUM") >= 2
