"""Nominal metrics from sparse class profiles: equal to the dense tables, and beyond their size."""

import numpy as np
import pytest

from casediff.operators import vdm
from casediff.operators.knn import knn_join
from casediff.plans import images as IM


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, v string, w string, z double, cls string")


def rows_of(n, values, classes, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, None if rng.random() < 0.03 else f"v{rng.integers(values)}", f"w{rng.integers(3)}", float(rng.normal()),
             f"c{rng.integers(classes)}") for i in range(n)]


@pytest.mark.parametrize("spec_of", [vdm.hvdm_spec, vdm.cvdhm_spec])
def test_profiles_equal_dense_tables(spark, spec_of, monkeypatch):
    df = frame(spark, rows_of(400, 12, 5))
    _, dense = spec_of(df, ["v", "w"], "cls")
    monkeypatch.setattr(vdm, "MAX_VALUES", 2)
    _, sparse = spec_of(df, ["v", "w"], "cls")
    for d, s in zip(dense.tables, sparse.tables, strict=True):
        assert isinstance(s, vdm.ProfileTable) and len(s) == len(d)
        codes = np.arange(len(d))
        assert np.allclose(s.matrix(codes, codes), d, atol=1e-12)
        a, b = np.repeat(codes, len(d)), np.tile(codes, len(d))
        assert np.allclose(s.pairs(a, b), d.reshape(-1), atol=1e-12)


def test_five_thousand_values_and_classes(spark):
    """Above the old limits of 1024 values and 1024 classes; neighbours share the value and so the profile."""
    rows = [(i, f"v{i % 5000}", f"w{i % 2}", 0.0, f"c{i % 5000}") for i in range(10_000)]
    df = frame(spark, rows)
    enc, spec = vdm.cvdhm_spec(df, ["v", "w"], "cls")
    assert len(spec.tables[0]) == 5001 and isinstance(spec.tables[0], vdm.ProfileTable)
    cases = df.select("id", enc.codes().alias("codes"), spark_array().alias("x"))
    asked = cases.where("id % 500 = 3")
    got = {r.query_id: r.neighbour_id for r in knn_join(asked, cases, 1, exclude_self=True, spec=spec).collect()}
    assert got == {i: (i + 5000) % 10_000 for i in range(3, 10_000, 500)}


def spark_array():
    from pyspark.sql import functions as F
    return F.array("z")


def test_sparse_lookup_keeps_the_pairs_that_share_a_class(spark, monkeypatch):
    df = frame(spark, rows_of(200, 15, 30))
    full = {(r.feature, r.v1, r.v2): r.d for r in vdm.cvdhm_lookup(df, ["v"], "cls").collect()}
    monkeypatch.setattr(vdm, "MAX_PAIR_VALUES", 3)
    some = {(r.feature, r.v1, r.v2): r.d for r in vdm.cvdhm_lookup(df, ["v"], "cls", sparse=True).collect()}
    assert len(some) < len(full)
    assert all(abs(some.get(k, 1.0) - d) < 1e-12 for k, d in full.items())
    with pytest.raises(ValueError, match="not be bounded"):
        vdm.cvdhm_lookup(df, ["v"], "cls")


def test_codes_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(vdm, "LITERALS", 2)
    enc = vdm.NominalEncoding(("v",), {"v": ["a", "b", "c"]})
    df = spark.createDataFrame([("a",), ("c",), (None,), ("zz",)], "v string")
    assert [r[0] for r in df.select(enc.codes()).collect()] == [[0], [2], [3], [3]]


def test_mean_difference_without_oneself(spark):
    df = spark.createDataFrame([(1, [0, 0], 0), (2, [10, 0], 0), (3, [30, 30], 0)], "id bigint, px array<int>, y int")
    with_self = {r.query_id: r.mean_diff for r in IM.mean_differences(df, df, 1).collect()}
    without = {r.query_id: r.mean_diff for r in IM.mean_differences(df, df, 1, exclude_self=True).collect()}
    assert with_self == {1: [0, 0], 2: [0, 0], 3: [0, 0]} and without == {1: [10, 0], 2: [10, 0], 3: [20, 30]}
