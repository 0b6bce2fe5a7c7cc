"""Registered queries: images.

A 64-float embedding becomes an 8x8x1 pseudo image with pixels
``round((v + 1) * 127.5)`` clipped to 0..255.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from casediff.operators import differences as D
from casediff.operators import vote as V
from casediff.operators.knn import knn_join
from casediff.operators.prep import train_test_split
from casediff.plans import images as IM
from casediff.plans.implicit_estimators import ImageClassifier, ImageRegressor
from casediff.plans.cases import K, bucket_sql, knn_sql, r6, sql_r6
from casediff.plans.registry import _with, register
from casediff.sources.images import flatten_image, pseudo_image
from casediff.sources.tables import read_table

SHAPE = (8, 8, 1)


def image_cases(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    imgs = emb.select(F.col("vec_id").alias("id"), pseudo_image("embedding").alias("px"),
                      F.col("label").alias("y"))
    return train_test_split(imgs, "id", 80, 2)


_IMG_SQL = f"""
im AS (SELECT vec_id AS id, label AS y, {bucket_sql('vec_id')} % 100 AS bucket,
              list_transform(embedding, lambda v: least(255, greatest(0,
                  CAST(round((v::DOUBLE + 1.0) * 127.5) AS INTEGER)))) AS px
       FROM embeddings),
itr AS (SELECT id, y, px FROM im WHERE bucket < 80),
ite AS (SELECT id, y, px FROM im WHERE bucket >= 80)"""

_PX_D2 = "CAST(list_sum(list_transform(list_zip(a.px, b.px), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS DOUBLE)"
_I_K1 = knn_sql("i1", "itr", "itr", _PX_D2, K, True)
_I_K2 = knn_sql("i2", "ite", "itr", _PX_D2, K, False)


@register("S5_image_flatten", _with(_IMG_SQL) + """
SELECT id, CAST(pos AS INTEGER) AS pos, px[pos + 1] AS px
FROM (SELECT id, px, unnest(range(len(px))) AS pos FROM im)""")
def s5_flatten(spark, sf):
    tr, te = image_cases(spark, sf)
    imgs = tr.unionByName(te)
    h, w, _ = SHAPE
    nested = imgs.select("id", F.transform(
        F.sequence(F.lit(0), F.lit(h - 1)),
        lambda r: F.transform(F.sequence(F.lit(0), F.lit(w - 1)),
                              lambda c: F.array(F.element_at("px", r * w + c + 1)))).alias("img"))
    flat = nested.select("id", flatten_image("img", 3).alias("px"))
    return flat.select("id", F.posexplode("px")).select("id", "pos", F.col("col").alias("px"))


@register("K10_image_knn", _with(_IMG_SQL, _I_K2) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM i2""")
def k10_image_knn(spark, sf):
    tr, te = image_cases(spark, sf)
    nb = knn_join(IM.as_vectors(te), IM.as_vectors(tr), K)
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


_ABS_LONG = """
SELECT query_id, neighbour_id, CAST(pos AS INTEGER) AS pos, abs(ax[pos + 1] - bx[pos + 1]) AS d FROM (
  SELECT nn.query_id, nn.neighbour_id, a.px AS ax, b.px AS bx, unnest(range(len(a.px))) AS pos
  FROM {nn} nn JOIN {q} a ON a.id = nn.query_id JOIN {c} b ON b.id = nn.neighbour_id)"""


@register("D10_abs_diff_image", _with(_IMG_SQL, _I_K1) + _ABS_LONG.format(nn="i1", q="itr", c="itr"))
def d10_abs_diff(spark, sf):
    tr, _ = image_cases(spark, sf)
    diffs = IM.fit_differences(tr, K)
    return diffs.select("query_id", "neighbour_id", F.posexplode("diff")).select(
        "query_id", "neighbour_id", "pos", F.col("col").alias("d"))


@register("D11_query_abs_diff", _with(_IMG_SQL, _I_K2) + _ABS_LONG.format(nn="i2", q="ite", c="itr"))
def d11_query_abs_diff(spark, sf):
    tr, te = image_cases(spark, sf)
    diffs = IM.query_differences(te, tr, K)
    return diffs.select("query_id", "neighbour_id", F.posexplode("diff")).select(
        "query_id", "neighbour_id", "pos", F.col("col").alias("d"))


@register("D12_mean_diff_image", _with(_IMG_SQL, _I_K2) + f"""
SELECT query_id, CAST(pos AS INTEGER) AS pos, {sql_r6('avg(abs(ax[pos + 1] - bx[pos + 1]))')} AS v FROM (
  SELECT i2.query_id, a.px AS ax, b.px AS bx, unnest(range(len(a.px))) AS pos
  FROM i2 JOIN ite a ON a.id = i2.query_id JOIN itr b ON b.id = i2.neighbour_id)
GROUP BY query_id, pos""")
def d12_mean_diff_image(spark, sf):
    tr, te = image_cases(spark, sf)
    m = IM.mean_differences(te, tr, K)
    return m.select("query_id", F.posexplode("mean_diff")).select(
        "query_id", "pos", r6("col").alias("v"))


_SCORED = """
sc AS (SELECT i2.query_id, i2.neighbour_id, i2.rank, b.y AS ny,
              list_avg(list_transform(list_zip(a.px, b.px), lambda p: abs(p[1] - p[2]))) AS md
       FROM i2 JOIN ite a ON a.id = i2.query_id JOIN itr b ON b.id = i2.neighbour_id)"""


@register("L6_external_model", _with(_IMG_SQL, _I_K2, _SCORED) + f"""
SELECT query_id, neighbour_id, {sql_r6('md / 255.0')} AS dhat FROM sc""")
def l6_external_model(spark, sf):
    tr, te = image_cases(spark, sf)
    pairs = IM.query_differences(te, tr, K)
    scored = IM.score_with_model(pairs, IM.MeanPixelModel(), SHAPE)
    return scored.select("query_id", "neighbour_id", r6("dhat").alias("dhat"))


_A6 = """
a6 AS (SELECT query_id, v AS prediction FROM (
  SELECT query_id, v, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, r) AS o
  FROM (SELECT query_id, ny + floor(md / 64.0) AS v, count(*) AS c, min(rank) AS r FROM sc GROUP BY ALL))
  WHERE o = 1)"""


@register("A6_image_vote", _with(_IMG_SQL, _I_K2, _SCORED, _A6) + f"""
SELECT query_id, {sql_r6('prediction')} AS prediction FROM a6""")
def a6_image_vote(spark, sf):
    tr, te = image_cases(spark, sf)
    p = IM.predict(te, tr, IM.PixelBandModel(), SHAPE, task="classification", k=K)
    return p.select("query_id", r6("prediction").alias("prediction"))


@register("U5_image_classifier", _with(_IMG_SQL, _I_K2, _SCORED, _A6) + f"""
SELECT query_id, {sql_r6('prediction')} AS prediction FROM a6""")
def u5_image_classifier(spark, sf):
    tr, te = image_cases(spark, sf)
    model = ImageClassifier(IM.PixelBandModel(), SHAPE, kPredict=K).fit(tr)
    return model.predictions(te).select(F.col("id").alias("query_id"), r6("prediction").alias("prediction"))


_A7 = """
a7 AS (SELECT query_id, avg(CAST(ny AS DOUBLE) + md / 255.0) AS prediction FROM sc GROUP BY query_id)"""


@register("A7_image_mean", _with(_IMG_SQL, _I_K2, _SCORED, _A7) + f"""
SELECT query_id, {sql_r6('prediction')} AS prediction FROM a7""")
def a7_image_mean(spark, sf):
    tr, te = image_cases(spark, sf)
    p = IM.predict(te, tr, IM.MeanPixelModel(), SHAPE, task="regression", k=K)
    return p.select("query_id", r6("prediction").alias("prediction"))


@register("U6_image_regressor", _with(_IMG_SQL, _I_K2, _SCORED, _A7) + f"""
SELECT query_id, {sql_r6('prediction')} AS prediction FROM a7""")
def u6_image_regressor(spark, sf):
    tr, te = image_cases(spark, sf)
    model = ImageRegressor(IM.MeanPixelModel(), SHAPE, kPredict=K).fit(tr)
    return model.predictions(te).select(F.col("id").alias("query_id"), r6("prediction").alias("prediction"))


@register("A8_round_label", _with(_IMG_SQL, _I_K2, _SCORED, _A7) + """
SELECT query_id, CAST(round_even(prediction, 0) AS INTEGER) AS label FROM a7""")
def a8_round_label(spark, sf):
    tr, te = image_cases(spark, sf)
    p = IM.predict(te, tr, IM.MeanPixelModel(), SHAPE, task="regression", k=K)
    return p.select("query_id", V.round_label("prediction").alias("label"))
