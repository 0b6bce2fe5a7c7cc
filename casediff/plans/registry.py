"""Registered queries (one per operator id of the blueprint) and their oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``
(DuckDB SQL over the same tables).  Doubles are published rounded to 6 places.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casediff.functions.arrays import sq_dist
from casediff.operators import differences as D
from casediff.operators import vote as V
from casediff.operators.adapters import ModeAdapter, OlsAdapter
from casediff.operators.knn import knn_join
from casediff.plans import learner as L
from casediff.plans.cases import (EMB_D2, EMB_SQL, K, PART_D2, PART_SQL, embedding_cases,
                                  knn_sql, ols_sql, part_cases, r5, r6, sql_r5, sql_r6)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes)


# ==========================================================================
# part: mixed regression
# ==========================================================================

_P_K1 = knn_sql("nn1", "tr", "tr", PART_D2, K, True)
_P_K2 = knn_sql("nn2", "te", "tr", PART_D2, K, False)


def _part_self_pairs(spark, sf):
    tr, te = part_cases(spark, sf)
    return L.neighbour_pairs(tr, tr, K, self_join=True), tr, te


def _part_query_pairs(spark, sf):
    tr, te = part_cases(spark, sf)
    return L.neighbour_pairs(te, tr, K, self_join=False), tr, te


@register("K1_self_knn", _with(PART_SQL, _P_K1) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM nn1""")
def k1_self_knn(spark, sf):
    tr, _ = part_cases(spark, sf)
    nb = knn_join(tr, tr, K, exclude_self=True)
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


@register("K2_query_knn", _with(PART_SQL, _P_K2) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM nn2""")
def k2_query_knn(spark, sf):
    tr, te = part_cases(spark, sf)
    nb = knn_join(te, tr, K)
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


_LONG_DIFF_SQL = """
SELECT query_id, neighbour_id, CAST(pos AS INTEGER) AS pos, {r} AS {out} FROM (
  SELECT nn.query_id, nn.neighbour_id, a.x AS ax, b.x AS bx, sqrt(nn.d2) AS dist,
         unnest(range({len})) AS pos
  FROM {nn} nn JOIN {q} a ON a.id = nn.query_id JOIN {c} b ON b.id = nn.neighbour_id)"""


@register("D1_feature_diff", _with(PART_SQL, _P_K1) + _LONG_DIFF_SQL.format(
    r=sql_r6("ax[pos + 1] - bx[pos + 1]"), out="dx", len="len(a.x)", nn="nn1", q="tr", c="tr"))
def d1_feature_diff(spark, sf):
    pairs, _, _ = _part_self_pairs(spark, sf)
    d = pairs.select("query_id", "neighbour_id", F.posexplode(D.feature_difference()))
    return d.select("query_id", "neighbour_id", "pos", r6("col").alias("dx"))


@register("D2_target_diff", _with(PART_SQL, _P_K1) + f"""
SELECT nn1.query_id, nn1.neighbour_id, {sql_r6('a.y - b.y')} AS dy
FROM nn1 JOIN tr a ON a.id = nn1.query_id JOIN tr b ON b.id = nn1.neighbour_id""")
def d2_target_diff(spark, sf):
    pairs, _, _ = _part_self_pairs(spark, sf)
    return pairs.select("query_id", "neighbour_id", r6(D.target_difference()).alias("dy"))


@register("D3_query_diff", _with(PART_SQL, _P_K2) + _LONG_DIFF_SQL.format(
    r=sql_r6("ax[pos + 1] - bx[pos + 1]"), out="dx", len="len(a.x)", nn="nn2", q="te", c="tr"))
def d3_query_diff(spark, sf):
    pairs, _, _ = _part_query_pairs(spark, sf)
    d = pairs.select("query_id", "neighbour_id", F.posexplode(D.feature_difference()))
    return d.select("query_id", "neighbour_id", "pos", r6("col").alias("dx"))


_CTX = "CASE WHEN pos % 2 = 0 THEN ax[pos // 2 + 1] - bx[pos // 2 + 1] ELSE ax[(pos - 1) // 2 + 1] END"


@register("D4_context_fit", _with(PART_SQL, _P_K1) + _LONG_DIFF_SQL.format(
    r=sql_r6(_CTX), out="v", len="2 * len(a.x)", nn="nn1", q="tr", c="tr"))
def d4_context_fit(spark, sf):
    pairs, _, _ = _part_self_pairs(spark, sf)
    d = pairs.select("query_id", "neighbour_id",
                     F.posexplode(D.with_context(D.feature_difference())))
    return d.select("query_id", "neighbour_id", "pos", r6("col").alias("v"))


@register("D5_context_predict", _with(PART_SQL, _P_K2) + _LONG_DIFF_SQL.format(
    r=sql_r6(_CTX), out="v", len="2 * len(a.x)", nn="nn2", q="te", c="tr"))
def d5_context_predict(spark, sf):
    pairs, _, _ = _part_query_pairs(spark, sf)
    d = pairs.select("query_id", "neighbour_id",
                     F.posexplode(D.with_context(D.feature_difference())))
    return d.select("query_id", "neighbour_id", "pos", r6("col").alias("v"))


_DUP_SQL = """
dd AS (SELECT query_id, neighbour_id, ln(sqrt(d2) + 1) AS l FROM nn1),
mm AS (SELECT min(l) AS lo, max(l) AS hi FROM dd),
cc AS (SELECT query_id, neighbour_id,
              CASE WHEN lo = hi THEN 1 ELSE CAST(round_even(10 - (l - lo) / (hi - lo) * 10, 0) AS INTEGER) END AS weight
       FROM dd, mm)"""


@register("D6_duplicate_by_distance", _with(PART_SQL, _P_K1, _DUP_SQL) + """
SELECT query_id, neighbour_id, weight, CAST(copy AS INTEGER) AS copy
FROM (SELECT *, unnest(generate_series(1, weight)) AS copy FROM cc WHERE weight > 0)""")
def d6_duplicate(spark, sf):
    pairs, _, _ = _part_self_pairs(spark, sf)
    diffs = D.difference_table(pairs)
    return D.duplicate_by_distance(diffs).select("query_id", "neighbour_id", "weight", "copy")


@register("D7_distance_column", _with(PART_SQL, _P_K1) + _LONG_DIFF_SQL.format(
    r=sql_r6("CASE WHEN pos < len(ax) THEN ax[pos + 1] - bx[pos + 1] ELSE dist END"),
    out="v", len="len(a.x) + 1", nn="nn1", q="tr", c="tr"))
def d7_distance_column(spark, sf):
    pairs, _, _ = _part_self_pairs(spark, sf)
    d = pairs.select("query_id", "neighbour_id",
                     F.posexplode(D.with_distance(D.feature_difference())))
    return d.select("query_id", "neighbour_id", "pos", r6("col").alias("v"))


_OLS_FIT_SQL = """
fit AS (SELECT """ + ols_sql("a.y - b.y", "a.z - b.z") + """
        FROM nn1 JOIN tr a ON a.id = nn1.query_id JOIN tr b ON b.id = nn1.neighbour_id)"""

_OLS_SCORE_SQL = """
sc AS (SELECT nn2.query_id, nn2.neighbour_id, nn2.rank, sqrt(nn2.d2) AS dist, b.y AS ny,
              s * (q.z - b.z) + i AS dhat
       FROM nn2 JOIN te q ON q.id = nn2.query_id JOIN tr b ON b.id = nn2.neighbour_id, fit)"""


def _part_ols(spark, sf):
    tr, te = part_cases(spark, sf)
    diffs = L.training_differences(tr, K)
    adapter = L.fit_adapter(diffs, OlsAdapter(0))
    scored = L.scored_query_pairs(te, tr, K, adapter)
    return adapter, scored, te


@register("L1_ols_adapter", _with(PART_SQL, _P_K1, _OLS_FIT_SQL) + f"""
SELECT {sql_r6('s')} AS slope, {sql_r6('i')} AS intercept FROM fit""")
def l1_ols_adapter(spark, sf):
    tr, _ = part_cases(spark, sf)
    adapter = L.fit_adapter(L.training_differences(tr, K), OlsAdapter(0))
    return spark.range(1).select(r6(F.lit(adapter.slope)).alias("slope"),
                                 r6(F.lit(adapter.intercept)).alias("intercept"))


@register("L4_score_differences", _with(PART_SQL, _P_K1, _P_K2, _OLS_FIT_SQL, _OLS_SCORE_SQL) + f"""
SELECT query_id, neighbour_id, {sql_r6('dhat')} AS dhat FROM sc""")
def l4_score(spark, sf):
    _, scored, _ = _part_ols(spark, sf)
    return scored.select("query_id", "neighbour_id", r6("dhat").alias("dhat"))


@register("A1_mean", _with(PART_SQL, _P_K1, _P_K2, _OLS_FIT_SQL, _OLS_SCORE_SQL) + f"""
SELECT query_id, {sql_r6('avg(ny + dhat)')} AS prediction FROM sc GROUP BY query_id""")
def a1_mean(spark, sf):
    _, scored, _ = _part_ols(spark, sf)
    p = L.aggregate(scored, "regression", weighted=False)
    return p.select("query_id", r6("prediction").alias("prediction"))


_A2_BODY = """
a2 AS (SELECT query_id, sum((1.0 / (dist + 1e-8)) * (ny + dhat)) / sum(1.0 / (dist + 1e-8)) AS prediction
       FROM sc GROUP BY query_id)"""


@register("A2_inverse_distance_mean",
          _with(PART_SQL, _P_K1, _P_K2, _OLS_FIT_SQL, _OLS_SCORE_SQL, _A2_BODY) + f"""
SELECT query_id, {sql_r6('prediction')} AS prediction FROM a2""")
def a2_inverse_distance_mean(spark, sf):
    _, scored, _ = _part_ols(spark, sf)
    p = L.aggregate(scored, "regression", weighted=True)
    return p.select("query_id", r6("prediction").alias("prediction"))


@register("U1_lr_ols",
          _with(PART_SQL, _P_K1, _P_K2, _OLS_FIT_SQL, _OLS_SCORE_SQL, _A2_BODY) + f"""
SELECT query_id AS id, {sql_r6('prediction')} AS prediction FROM a2""")
def u1_lr_ols(spark, sf):
    from casediff.plans.estimators import DifferenceRegressor
    tr, te = part_cases(spark, sf)
    model = DifferenceRegressor(adapter="ols").fit(tr)
    return model.transform(te).select("id", r6("prediction").alias("prediction"))


@register("E6_neg_mae",
          _with(PART_SQL, _P_K1, _P_K2, _OLS_FIT_SQL, _OLS_SCORE_SQL, _A2_BODY) + f"""
SELECT {sql_r5('-avg(abs(a2.prediction - te.y))')} AS neg_mae
FROM a2 JOIN te ON te.id = a2.query_id""")
def e6_neg_mae(spark, sf):
    from casediff.plans.evaluate import neg_mae
    _, scored, te = _part_ols(spark, sf)
    p = L.aggregate(scored, "regression", weighted=True)
    j = p.join(te.select(F.col("id").alias("query_id"), "y"), "query_id")
    return neg_mae(j, "prediction", "y").select(r5("neg_mae").alias("neg_mae"))


@register("E7_mse",
          _with(PART_SQL, _P_K1, _P_K2, _OLS_FIT_SQL, _OLS_SCORE_SQL, _A2_BODY) + f"""
SELECT {sql_r5('avg((a2.prediction - te.y) * (a2.prediction - te.y))')} AS mse
FROM a2 JOIN te ON te.id = a2.query_id""")
def e7_mse(spark, sf):
    from casediff.plans.evaluate import mse
    _, scored, te = _part_ols(spark, sf)
    p = L.aggregate(scored, "regression", weighted=True)
    j = p.join(te.select(F.col("id").alias("query_id"), "y"), "query_id")
    return mse(j, "prediction", "y").select(r5("mse").alias("mse"))


@register("E8_target_variance", _with(PART_SQL) + f"""
SELECT {sql_r6('var_pop(y)')} AS var_y FROM te""")
def e8_var(spark, sf):
    """Population variance of the target over the test split (20 % of ``part``), the base line of its MSE."""
    from casediff.plans.evaluate import target_variance
    _, te = part_cases(spark, sf)
    return target_variance(te, "y").select(r6("var_y").alias("var_y"))


_B_PAIRS = """
bp AS (SELECT nn2.query_id, nn2.rank, sqrt(nn2.d2) AS dist, b.y AS ny
       FROM nn2 JOIN tr b ON b.id = nn2.neighbour_id)"""


@register("B1_knn_mean", _with(PART_SQL, _P_K2, _B_PAIRS) + f"""
SELECT query_id, {sql_r6('avg(ny)')} AS prediction FROM bp GROUP BY query_id""")
def b1_knn_mean(spark, sf):
    tr, te = part_cases(spark, sf)
    p = L.knn_baseline(tr, te, K, task="regression", weighted=False)
    return p.select("query_id", r6("prediction").alias("prediction"))


@register("B2_knn_weighted_mean", _with(PART_SQL, _P_K2, _B_PAIRS) + f"""
SELECT query_id, {sql_r6('''CASE WHEN sum(CASE WHEN dist = 0 THEN 1 ELSE 0 END) > 0
                    THEN avg(CASE WHEN dist = 0 THEN ny END)
                    ELSE sum(ny / dist) / sum(1.0 / dist) END''')} AS prediction
FROM bp GROUP BY query_id""")
def b2_knn_weighted_mean(spark, sf):
    tr, te = part_cases(spark, sf)
    p = L.knn_baseline(tr, te, K, task="regression", weighted=True)
    return p.select("query_id", r6("prediction").alias("prediction"))


# ==========================================================================
# embeddings: classification
# ==========================================================================

_E_K1 = knn_sql("en1", "etr", "etr", EMB_D2, K, True)
_E_K2 = knn_sql("en2", "ete", "etr", EMB_D2, K, False)


@register("K1_embedding_self_knn", _with(EMB_SQL, _E_K1) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM en1""")
def k1_emb(spark, sf):
    tr, _ = embedding_cases(spark, sf)
    nb = knn_join(tr, tr, K, exclude_self=True)
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


@register("K2_embedding_knn_tiles", _with(EMB_SQL, _E_K2) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM en2""")
def k2_emb_tiles(spark, sf):
    tr, te = embedding_cases(spark, sf)
    # One case block here; ``casediff.knn.tileRows`` sets smaller ones.
    nb = knn_join(te, tr, K, strategy="tiles")
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


@register("K2_embedding_knn_cells", _with(EMB_SQL, _E_K2) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM en2""")
def k2_emb_cells(spark, sf):
    tr, te = embedding_cases(spark, sf)
    nb = knn_join(te, tr, K, strategy="cells")
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


_E_K2_2 = knn_sql("e22", "ete", "etr", EMB_D2, 2, False)


@register("K11_case_lookup", _with(EMB_SQL, _E_K2_2) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM e22""")
def k11_case_lookup(spark, sf):
    """The 2 nearest training cases of a case; run for every test case (a one-row
    query table is the same operator)."""
    tr, te = embedding_cases(spark, sf)
    nb = knn_join(te, tr, 2)
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


@register("M1_euclidean", _with(EMB_SQL, _E_K2) + f"""
SELECT query_id, neighbour_id, {sql_r6('sqrt(d2)')} AS dist FROM en2""")
def m1_euclidean(spark, sf):
    tr, te = embedding_cases(spark, sf)
    nb = knn_join(te, tr, K, keep=[("q_x", "x")], carry=[("n_x", "x")])
    return nb.select("query_id", "neighbour_id",
                     r6(F.sqrt(sq_dist("q_x", "n_x"))).alias("dist"))


_E_VOTE_PAIRS = """
vp AS (SELECT en2.query_id, en2.rank, sqrt(en2.d2) AS dist, b.y AS ny
       FROM en2 JOIN etr b ON b.id = en2.neighbour_id)"""


@register("B3_knn_vote", _with(EMB_SQL, _E_K2, _E_VOTE_PAIRS) + """
SELECT query_id, ny AS prediction FROM (
  SELECT query_id, ny, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, ny) AS o
  FROM (SELECT query_id, ny, count(*) AS c FROM vp GROUP BY ALL)) WHERE o = 1""")
def b3_knn_vote(spark, sf):
    tr, te = embedding_cases(spark, sf)
    return L.knn_baseline(tr, te, K, task="classification", weighted=False)


@register("B4_knn_weighted_vote", _with(EMB_SQL, _E_K2, _E_VOTE_PAIRS) + """
, w AS (SELECT query_id, ny, dist,
               max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS z FROM vp)
SELECT query_id, ny AS prediction FROM (
  SELECT query_id, ny, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ny) AS o
  FROM (SELECT query_id, ny,
               round(t / max(t) OVER (PARTITION BY query_id), 9) AS s
        FROM (SELECT query_id, ny, sum(CASE WHEN z = 1 THEN CASE WHEN dist = 0 THEN 1.0 ELSE 0.0 END
                                            ELSE 1.0 / dist END) AS t
              FROM w GROUP BY ALL))) WHERE o = 1""")
def b4_knn_weighted_vote(spark, sf):
    tr, te = embedding_cases(spark, sf)
    return L.knn_baseline(tr, te, K, task="classification", weighted=True)


_E_MODE = """
md AS (SELECT d AS dhat FROM (
         SELECT CAST(a.y - b.y AS DOUBLE) AS d, count(*) AS c
         FROM en1 JOIN etr a ON a.id = en1.query_id JOIN etr b ON b.id = en1.neighbour_id
         GROUP BY 1) ORDER BY c DESC, d LIMIT 1),
sv AS (SELECT en2.query_id, en2.rank, sqrt(en2.d2) AS dist, b.y + md.dhat AS v
       FROM en2 JOIN etr b ON b.id = en2.neighbour_id, md)"""

_A3_SQL = """
a3 AS (SELECT query_id, v AS prediction FROM (
  SELECT query_id, v, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, r) AS o
  FROM (SELECT query_id, v, count(*) AS c, min(rank) AS r FROM sv GROUP BY ALL)) WHERE o = 1)"""


def _emb_lc(spark, sf, weighted: bool):
    tr, te = embedding_cases(spark, sf)
    return L.fit_predict(tr, te, task="classification", adapter=ModeAdapter(),
                         weighted=weighted), te


@register("A3_majority_vote", _with(EMB_SQL, _E_K1, _E_K2, _E_MODE, _A3_SQL) + f"""
SELECT query_id, {sql_r6('prediction')} AS prediction FROM a3""")
def a3_majority_vote(spark, sf):
    p, _ = _emb_lc(spark, sf, weighted=False)
    return p.select("query_id", r6("prediction").alias("prediction"))


@register("A4_inverse_distance_vote", _with(EMB_SQL, _E_K1, _E_K2, _E_MODE) + f"""
SELECT query_id, {sql_r6('v')} AS prediction FROM (
  SELECT query_id, v, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS o
  FROM (SELECT query_id, v, r, round(t / max(t) OVER (PARTITION BY query_id), 9) AS s
        FROM (SELECT query_id, v, sum(1.0 / (dist + 1e-8)) AS t, min(rank) AS r
              FROM sv GROUP BY ALL))) WHERE o = 1""")
def a4_inverse_distance_vote(spark, sf):
    p, _ = _emb_lc(spark, sf, weighted=True)
    return p.select("query_id", r6("prediction").alias("prediction"))


@register("U2_lc_mode", _with(EMB_SQL, _E_K1, _E_K2, _E_MODE, _A3_SQL) + f"""
SELECT query_id AS id, {sql_r6('prediction')} AS prediction FROM a3""")
def u2_lc_mode(spark, sf):
    from casediff.plans.estimators import DifferenceClassifier
    tr, te = embedding_cases(spark, sf)
    model = DifferenceClassifier(adapter="mode").fit(tr)
    return model.transform(te).select("id", r6("prediction").alias("prediction"))


@register("E5_accuracy", _with(EMB_SQL, _E_K1, _E_K2, _E_MODE, _A3_SQL) + f"""
SELECT {sql_r6('avg(CASE WHEN a3.prediction = ete.y THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM a3 JOIN ete ON ete.id = a3.query_id""")
def e5_accuracy(spark, sf):
    from casediff.plans.evaluate import accuracy
    p, te = _emb_lc(spark, sf, weighted=False)
    j = p.join(te.select(F.col("id").alias("query_id"), "y"), "query_id")
    return accuracy(j, "prediction", "y").select(r6("accuracy").alias("accuracy"))


@register("A9_distinct_classes", "WITH e_all AS (SELECT label AS y FROM embeddings) SELECT DISTINCT y AS label FROM e_all")
def a9_distinct(spark, sf):
    tr, te = embedding_cases(spark, sf)
    return V.distinct_classes(tr.unionAll(te).withColumnRenamed("y", "label"), "label")


@register("A10_class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def a10_counts(spark, sf):
    tr, te = embedding_cases(spark, sf)
    return V.class_counts(tr.unionAll(te).withColumnRenamed("y", "label"), "label")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification by differences on ``embeddings`` (K1 -> D1/D2 -> mode adapter -> K2 -> A3)."""
    return a3_majority_vote(spark, sf_dir)


_EXTRA_MODULES = ("casediff.plans.registry_prep", "casediff.plans.registry_metrics",
                  "casediff.plans.registry_implicit", "casediff.plans.registry_images",
                  "casediff.plans.registry_eval")


def _load_all() -> None:
    import importlib
    for m in _EXTRA_MODULES:
        importlib.import_module(m)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return QUERIES


def all_oracle() -> dict[str, str]:
    _load_all()
    return ORACLE
