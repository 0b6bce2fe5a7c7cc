"""What a task of a neighbour join holds in the plans that use it: blocks of bounded size, and no vectors among candidates."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casediff.operators import knn_cells
from casediff.operators.adapters import ModeAdapter
from casediff.plans import images as IM
from casediff.plans import implicit as I
from casediff.plans import learner as L

TILE = 300


def table(spark, n, image=False):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (n, 6)).tolist() if image else rng.normal(size=(n, 6)).tolist()
    y = rng.integers(0, 3, n).tolist()
    schema = T.StructType([T.StructField("id", T.LongType()),
                           T.StructField("px" if image else "x", T.ArrayType(T.IntegerType() if image else T.DoubleType())),
                           T.StructField("y", T.IntegerType())])
    d = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(x, y, strict=True))], schema)
    return d.where(F.col("id") % 5 > 0), d.where(F.col("id") % 5 == 0)


def implicit(tr, te):
    """U3, A5, K5, K6, R5"""
    model = I.fit_implicit(tr, n_neighbours=2, strategy="cells")
    out = model.predict(te).collect()
    model.release()
    return out


def differences(tr, te):
    """A3, A4, E5, L2, U2"""
    return L.fit_predict(tr, te, task="classification", adapter=ModeAdapter(), strategy="cells").collect()


def images(tr, te):
    """D10, A7, U6"""
    assert IM.fit_differences(tr, 2, strategy="cells").where(F.size("diff") == 6).count() == 2 * tr.count()
    return IM.predict(te, tr, IM.MeanPixelModel(), (2, 3, 1), task="regression", k=2, strategy="cells").collect()


@pytest.mark.parametrize("plan", [implicit, differences, images])
def test_tasks_hold_blocks_and_send_ids(spark, monkeypatch, plan):
    spark.conf.set("casediff.knn.tileRows", str(TILE))
    real, blocks, sent = knn_cells._meet, [], []

    def meet(q, c, keys, n, task, schema):
        out = real(q, c, keys, n, task, schema)
        if "neighbour_id" in schema.names:
            blocks.append(c.groupBy(*keys).count().agg(F.max("count")).first()[0])
            sent.append([f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)])
        return out

    monkeypatch.setattr(knn_cells, "_meet", meet)
    try:
        tr, te = table(spark, 1000, plan is images)
        assert len(plan(tr, te)) == te.count()
    finally:
        spark.conf.unset("casediff.knn.tileRows")
    assert len(sent) >= 2 and not any(sent)
    # blocks of a large cell are dealt by a hash, so a few rows more than the bound
    assert max(blocks) <= 1.3 * TILE < tr.count()
