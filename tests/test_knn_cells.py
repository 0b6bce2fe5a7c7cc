"""Exact joins that skip work: distances counted, results equal to brute force."""

import numpy as np
import pytest
from pyspark.sql import types as T

from casediff.operators import knn, knn_cells
from casediff.operators.knn import DistanceSpec, broadcast_cases, distinct_cases, knn_join

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())),
                       T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("cls", T.StringType()),
                       T.StructField("grp", T.LongType()), T.StructField("y", T.DoubleType())])


def clusters(n, dim=2, seed=1, repeat=1, missing=0.0, first=0):
    rng = np.random.default_rng(seed)
    centre = rng.uniform(-50, 50, (12, dim))
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, dim))
    x = np.round(x[rng.integers(0, max(1, n // repeat), n)] if repeat > 1 else x, 2)
    rows = []
    for i in range(n):
        v = [None if rng.random() < missing else float(a) for a in x[i]]
        rows.append((first + i, v, [int(rng.integers(0, 3))], [None, "a", "b", "c"][int(rng.integers(0, 4))],
                     int(rng.integers(0, 5)), float(i)))
    return rows


def frame(spark, rows, codes=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df if codes else df.drop("codes")


def brute(queries, cases, k, exclude_self=False, spec=knn.EUCLIDEAN, by=False, match=False, exclude=False):
    """All pairs in one matrix, one sort a query."""
    a, b = (np.array([[np.nan if v is None else v for v in r[1]] for r in rows], dtype=float) for rows in (queries, cases))
    diff = np.abs(a[:, None, :] - b[None, :, :])
    diff = np.where(np.isnan(diff), 1.0, np.minimum(diff, 1.0) if spec.numeric == "clip" else diff)
    d2 = np.zeros(diff.shape[:2])
    for j in range(diff.shape[2]):
        d2 += diff[:, :, j] ** 2
    for t in spec.tables:
        d2 += t[np.array([r[2][0] for r in queries])[:, None], np.array([r[2][0] for r in cases])[None, :]]
    d2 = knn._digits(d2)
    ids = np.array([c[0] for c in cases])
    out = []
    for i, q in enumerate(queries):
        groups = {}
        for j in np.lexsort((ids, d2[i])):
            c = cases[j]
            if (exclude_self and c[0] == q[0]) or (match and c[4] != q[4]) or (exclude and c[4] == q[4]):
                continue
            some = groups.setdefault(c[3] if by else 0, [])
            if len(some) < k:
                some.append(c[0])
        for cls, some in groups.items():
            out += [(q[0], n, r + 1) + ((cls,) if by else ()) for r, n in enumerate(some)]
    return sorted(out, key=str)


def result(df, by=False):
    return sorted(((r.query_id, r.neighbour_id, r["rank"]) + ((r.cls,) if by else ()) for r in df.collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(knn_cells, "PROBE_ROWS", 40)
    monkeypatch.setattr(knn_cells, "RING", 16)


TABLE = np.array([[0.0, 0.5, 1.0], [0.5, 0.0, 2.0], [1.0, 2.0, 0.0]])


@pytest.mark.parametrize("how", ["self", "query", "missing", "clip", "tables", "by", "folds", "copies"])
def test_cells_equal_brute_force_and_skip(spark, small_blocks, how):
    spec = {"clip": DistanceSpec(numeric="clip"), "tables": DistanceSpec(tables=(TABLE,), final="half")}.get(how, knn.EUCLIDEAN)
    rows = clusters(700, missing=0.02 if how == "missing" else 0, repeat=9 if how == "copies" else 1)
    if how == "clip":
        rows = [(i, [v / 60 for v in x], *rest) for i, x, *rest in rows]
    asked = rows if how in ("self", "copies") else clusters(120, seed=2, first=10_000, missing=0.02 if how == "missing" else 0)
    if how == "clip":
        asked = [(i, [v / 60 for v in x], *rest) for i, x, *rest in asked]
    kw = {"exclude_self": how in ("self", "copies"), "by": "cls" if how == "by" else None,
          "exclude_group": "grp" if how == "folds" else None}
    counter = spark.sparkContext.accumulator(0)
    cases = frame(spark, rows, how == "tables")
    queries = cases if asked is rows else frame(spark, asked, how == "tables")
    got = knn_join(queries, cases, 4, spec=spec, strategy="cells", tile_rows=90, counter=counter, **kw)
    assert result(got, how == "by") == brute(asked, rows, 4, kw["exclude_self"], spec, how == "by", exclude=how == "folds")
    pairs = len(asked) * len(rows)
    assert counter.value < (0.9 if how in ("by", "missing") else 0.5) * pairs


def test_cells_with_hot_vector_and_far_query(spark, small_blocks):
    rows = clusters(300) + [(1000 + i, [7.0, 7.0], [0], "a", 0, 0.0) for i in range(300)]
    rows += [(2000, [1e9, -1e9], [0], "a", 0, 0.0), (2001, None, [0], "a", 0, 0.0), (2002, [float("inf"), 1.0], [0], "a", 0, 0.0)]
    plain = [(i, [None if v is None or not np.isfinite(v) else v for v in (x or [None, None])], *rest) for i, x, *rest in rows]
    d = frame(spark, rows)
    got = knn_join(d, d, 3, exclude_self=True, strategy="cells", tile_rows=64)
    assert result(got) == brute(plain, plain, 3, True)


def test_partitions_follow_visits_not_all_pairs(spark, small_blocks, monkeypatch):
    """Twice the rows: about twice the tasks of the last step (tiles would need four times as many)."""
    seen = []
    real = knn_cells._meet
    monkeypatch.setattr(knn_cells, "_meet", lambda q, c, keys, n, f, s: (seen.append(n), real(q, c, keys, n, f, s))[1])
    for n in (1500, 3000):
        d = frame(spark, clusters(n, seed=5))
        knn_join(d, d, 2, exclude_self=True, strategy="cells", tile_rows=100)
    small, large = seen[1], seen[3]
    assert large <= 2.6 * small


@pytest.mark.parametrize("strategy", ["groups", "broadcast"])
def test_groups(spark, strategy):
    rows = [(*r[:4], r[4] % 3 or None, r[5]) if r[0] % 2 else (*r[:4], 7, r[5]) for r in clusters(300)]
    counter = spark.sparkContext.accumulator(0)
    d = frame(spark, rows)
    got = knn_join(d, d, 3, exclude_self=True, match_group="grp", strategy=strategy, tile_rows=40, counter=counter)
    assert result(got) == brute(rows, rows, 3, True, match=True)
    assert counter.value < 0.5 * len(rows) ** 2


def test_dictionary_compares_distinct_vectors(spark):
    rows = clusters(3000, repeat=60)
    distinct = len({tuple(r[1]) for r in rows})
    assert distinct <= 50
    d = frame(spark, rows)
    assert distinct_cases(d, 3).count() <= 4 * distinct
    counter = spark.sparkContext.accumulator(0)
    got = knn_join(d.coalesce(1), d, 3, exclude_self=True, strategy="broadcast", counter=counter)
    assert result(got) == brute(rows, rows, 3, True)
    assert counter.value < 200 * distinct * 4 * distinct
    for kw in ({"by": "cls"}, {"exclude_group": "grp"}):
        got = knn_join(d, d, 3, strategy="broadcast", **kw)
        assert result(got, "by" in kw) == brute(rows, rows, 3, by="by" in kw, exclude="exclude_group" in kw)
    base = broadcast_cases(d, k=3)
    assert result(knn_join(d, base, 2, exclude_self=True)) == brute(rows, rows, 2, True)
    with pytest.raises(ValueError, match="up to 3"):
        knn_join(d, base, 4)


def test_several_tiles(spark):
    rows = clusters(400)
    d = frame(spark, rows)
    assert result(knn_join(d, d, 3, exclude_self=True, strategy="tiles", tile_rows=64)) == brute(rows, rows, 3, True)


@pytest.mark.parametrize("strategy", ["broadcast", "tiles", "cells"])
def test_null_class_and_null_id(spark, strategy):
    rows = clusters(80)
    d = frame(spark, rows)
    got = knn_join(d, d, 2, by="cls", strategy=strategy)
    assert result(got, True) == brute(rows, rows, 2, by=True)
    assert {r.cls for r in got.collect()} == {None, "a", "b", "c"}
    big = 2**60 + 1
    odd = frame(spark, [(big, [0.0, 0.0], [0], "a", 0, 0.0), (big + 1, [1.0, 0.0], [0], "a", 0, 0.0)])
    assert result(knn_join(odd, odd, 1, exclude_self=True, strategy=strategy)) == [(big, big + 1, 1), (big + 1, big, 1)]
    with pytest.raises(Exception, match="null id"):
        null = frame(spark, [(None, [0.0, 0.0], [0], "a", 0, 0.0), (1, [1.0, 0.0], [0], "a", 0, 0.0)])
        knn_join(null, null, 1, strategy=strategy).collect()


def test_null_number_class(spark):
    d = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], None), (3, [2.0], 2)], "id bigint, x array<double>, cls int")
    got = knn_join(d, d, 1, by="cls").collect()
    assert {(r.query_id, r.neighbour_id, r.cls) for r in got} == {(q, n, c) for q in (1, 2, 3) for n, c in ((1, 1), (2, None), (3, 2))}
