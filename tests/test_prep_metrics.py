"""Preparation (P), metrics (M), discretisation (T), images and the driver contract."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casediff.operators import prep as P
from casediff.operators import vdm as M
from casediff.operators.discretise import EqualFrequency, EqualWidth
from casediff.operators.knn import knn_join
from casediff.schema import CaseSchema


def test_constant_column_divides_by_one_and_mean_impute(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id long, v double")
    stats = P.fit_numeric_stats(df, ["v"])
    assert stats["v"] == (5.0, 1.0)


def test_imputed_std_matches_imputed_column(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "id long, v double")
    mean, std = P.fit_numeric_stats(df, ["v"])["v"]
    assert mean == 2.0
    assert std == pytest.approx(np.std([1.0, 3.0, 2.0]))


def test_onehot_unknown_is_all_zeros_and_mode_tie_smallest(spark):
    tr = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, "a", 4.0)],
                               "id long, c string, y double")
    prep = P.fit_preparation(tr, CaseSchema("id", "y", (), ("c",)))
    assert prep.nominal_stats["c"] == ("a", ["a", "b"])
    te = spark.createDataFrame([(9, "z", 0.0), (10, None, 0.0)], "id long, c string, y double")
    xs = {r["id"]: r["x"] for r in prep.transform(te).collect()}
    assert xs[9] == [0.0, 0.0]          # unseen -> zeros
    assert xs[10] == [1.0, 0.0]         # null -> imputed mode "a"


def test_split_is_stable_and_complete(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    tr, te = P.train_test_split(df, "k", 80, 2)
    a = {r["k"] for r in tr.collect()}
    b = {r["k"] for r in te.repartition(5).collect()}
    assert not a & b and len(a | b) == 1000 and 700 < len(a) < 900


def _nominal(spark, rows):
    return spark.createDataFrame(rows, "id long, f string, cls int")


def test_vdm_matches_definition_and_unseen_costs_one_per_class(spark):
    rows = [(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, "b", 1), (5, "c", 0)]
    lk = {(r["v1"], r["v2"]): r["d"] for r in M.vdm_lookup(_nominal(spark, rows), ["f"], "cls").collect()}
    # P(c|a) = (.5, .5), P(c|b) = (0, 1), P(c|c) = (1, 0)
    assert lk[("a", "b")] == pytest.approx(math.sqrt(0.25 + 0.25))
    assert lk[("b", "c")] == pytest.approx(math.sqrt(2.0))
    assert lk[("a", "a")] == 0.0
    enc, spec = M.hvdm_spec(_nominal(spark, rows), ["f"], "cls")
    assert spec.tables[0][-1, 0] == 2.0          # unseen: 1 per class, 2 classes


def test_cvdhm_same_value_zero_unseen_one_and_null_feature(spark):
    rows = [(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, "b", 1), (5, "c", 0)]
    lk = {(r["v1"], r["v2"]): r["d"] for r in M.cvdhm_lookup(_nominal(spark, rows), ["f"], "cls").collect()}
    # P(v|c0): a .5, c .5; P(v|c1): a 1/3, b 2/3
    pa, pb = (0.5, 1 / 3), (0.0, 2 / 3)
    want = sum(abs(x - y) for x, y in zip(pa, pb)) / sum(x + y for x, y in zip(pa, pb))
    assert lk[("a", "b")] == pytest.approx(want)
    assert lk[("a", "a")] == 0.0
    enc, spec = M.cvdhm_spec(_nominal(spark, rows), ["f"], "cls")
    assert spec.tables[0][-1, 0] == 1.0
    # null numeric feature costs 1 under the clipped metric
    schema = T.StructType([T.StructField("id", T.LongType()),
                           T.StructField("x", T.ArrayType(T.DoubleType())),
                           T.StructField("codes", T.ArrayType(T.IntegerType()))])
    c = spark.createDataFrame([(1, [None], [0])], schema)
    q = spark.createDataFrame([(9, [0.3], [0])], schema)
    d = knn_join(q, c, 1, spec=spec).first()["dist"]
    assert d == pytest.approx(1.0)


def test_equal_width_out_of_range_is_null_and_labels(spark):
    tr = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 9.0)], "id long, y double")
    ew = EqualWidth(3).fit(tr, "y")
    te = spark.createDataFrame([(4, -1.0), (5, 3.0), (6, 9.0), (7, 10.0)], "id long, y double")
    got = {r["id"]: (r["s"], r["l"]) for r in
           te.select("id", ew.segment("y").alias("s")).select("id", "s", ew.label("s").alias("l")).collect()}
    assert got == {4: (None, None), 5: (1, "3-6"), 6: (2, "6-9"), 7: (None, None)}


def test_equal_frequency_edges_interpolate(spark):
    tr = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 4, 9])], "id long, y double")
    ef = EqualFrequency(2).fit(tr, "y")
    assert ef.edges == [1.0, 3.0, 9.0]
    segs = [r["s"] for r in tr.select("y", ef.segment("y").alias("s")).orderBy("y").collect()]
    assert segs == [1, 1, 2, 2]


def test_bright_dark_pixels_do_not_wrap(spark):
    from casediff.plans import images as IM
    imgs = spark.createDataFrame([(1, [3, 250], 0), (2, [250, 3], 1)], "id long, px array<int>, y int")
    d = IM.fit_differences(imgs, 1).where("query_id = 1").first()["diff"]
    assert d == [247, 247]


def test_driver_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "prediction"]


def test_image_predict_with_external_model_and_mean_difference(spark):
    from casediff.operators import differences as D
    from casediff.plans import images as IM
    tr = spark.createDataFrame([(1, [0, 0, 0, 0], 1), (2, [10, 10, 10, 10], 2),
                                (3, [100, 100, 100, 100], 3)], "id long, px array<int>, y int")
    te = spark.createDataFrame([(9, [4, 4, 4, 4], 0)], "id long, px array<int>, y int")
    # neighbours of [4,4,4,4] (k=2): case 1 (|diff| 4) and case 2 (|diff| 6)
    p = IM.predict(te, tr, IM.MeanPixelModel(), (2, 2, 1), task="regression", k=2).first()
    assert p["prediction"] == pytest.approx(((1 + 4 / 255) + (2 + 6 / 255)) / 2)
    pairs = knn_join(IM.as_vectors(te), IM.as_vectors(tr), 2, keep=[("q_x", "px")],
                     carry=[("n_x", "px")])
    m = D.mean_difference_image(pairs).first()["mean_diff"]
    assert m == [5.0, 5.0, 5.0, 5.0]


def test_many_labels_are_encoded_by_a_table(spark):
    """Three times the old limit of distinct labels: numbered in their order without the driver seeing them."""
    from pyspark.sql import functions as F
    from casediff.operators import prep
    n = 3 * prep.MAX_VOCABULARY
    df = spark.range(n, numPartitions=8).select("id", F.format_string("v%07d", (F.col("id") * 7919) % n).alias("label"))
    codes = prep.value_codes(df, "label")
    got = prep.encode_by_table(df, "label", codes)
    assert got.where(F.col("code") == (F.col("id") * 7919) % n).count() == n
    odd = spark.createDataFrame([("v0000001",), ("zz",), (None,)], "label string")
    assert [r.code for r in prep.encode_by_table(odd, "label", codes).orderBy(F.asc_nulls_last("label")).collect()] == [1, None, None]
    assert prep.fit_modes(df.unionByName(spark.createDataFrame([(0, "v0000005")], "id bigint, label string")), ["label"]) == {
        "label": "v0000005"}
    assert prep.fit_modes(odd.where("label is null"), ["label"]) == {"label": None} and prep.fit_modes(odd, []) == {}
    assert prep.value_codes(odd.where("false"), "label").count() == 0
