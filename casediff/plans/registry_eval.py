"""Registered queries: learner variants (V1-V3 through D4/D6/D7), parameters (U7, U8),
evaluation and tuning (E1-E4, E9) and model baselines (B5, B6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casediff.operators.adapters import LinearAdapter, OlsAdapter, TreeAdapter
from casediff.operators.discretise import EqualFrequency
from casediff.operators.knn import knn_join
from casediff.operators.prep import fit_preparation, fold_of, train_test_split
from casediff.operators.sampling import stratified_folds
from casediff.plans import evaluate as E
from casediff.plans import learner as L
from casediff.plans.cases import (K, EMB_D2, EMB_SQL, PART_D2, PART_SCHEMA, PART_SQL, bucket_sql, embedding_cases,
                                  knn_sql, ols_sql, part_cases, r5, r6, rank_key_sql, sql_r5, sql_r6)
from casediff.plans.learner_sql import ridge_sql, score_sql, tree_score_sql, tree_sql
from casediff.plans.estimators import DifferenceClassifier, DifferenceRegressor
from casediff.plans.registry import _with, register
from casediff.plans.registry_metrics import (_CV_SQL, _DOC_K1_CV, _DOC_K2_CV, _DOC_SQL, _K7_SQL,
                                             document_cases)
from casediff.sources.tables import read_table

_P_K1 = knn_sql("nn1", "tr", "tr", PART_D2, K, True)
_P_K2 = knn_sql("nn2", "te", "tr", PART_D2, K, False)

_PAIRS1 = """
p1 AS (SELECT nn1.query_id, nn1.neighbour_id, sqrt(nn1.d2) AS dist, a.y - b.y AS dy,
              a.z - b.z AS dz, a.z AS bz
       FROM nn1 JOIN tr a ON a.id = nn1.query_id JOIN tr b ON b.id = nn1.neighbour_id),
p2 AS (SELECT nn2.query_id, sqrt(nn2.d2) AS dist, b.y AS ny, q.z - b.z AS dz, q.z AS qz
       FROM nn2 JOIN te q ON q.id = nn2.query_id JOIN tr b ON b.id = nn2.neighbour_id)"""

_WEIGHTS = """
mm AS (SELECT min(ln(dist + 1)) AS lo, max(ln(dist + 1)) AS hi FROM p1),
pw AS (SELECT p1.*, CASE WHEN lo = hi THEN 1
                         ELSE CAST(round_even(10 - (ln(dist + 1) - lo) / (hi - lo) * 10, 0) AS INTEGER) END AS w
       FROM p1, mm)"""


def _wls(x: str) -> str:
    """Weighted least squares of dy on ``x`` over ``pw`` rows with w > 0."""
    return f"""
sums AS (SELECT sum(w) AS n, sum(w * {x}) AS sx, sum(w * dy) AS sy, sum(w * {x} * {x}) AS sxx,
                sum(w * {x} * dy) AS sxy FROM pw WHERE w > 0),
sl AS (SELECT CASE WHEN n * sxx - sx * sx = 0 THEN 0.0
                   ELSE (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS s, sx, sy, n FROM sums),
fit AS (SELECT s, (sy - s * sx) / n AS i FROM sl)"""


def _a2(x: str) -> str:
    return f"""
SELECT query_id, {sql_r6('sum((1.0 / (dist + 1e-8)) * (ny + s * ' + x + ' + i)) / sum(1.0 / (dist + 1e-8))')} AS prediction
FROM p2, fit GROUP BY query_id"""


def _variant(spark, sf, variant: L.Variant, index: int):
    tr, te = part_cases(spark, sf)
    p = L.fit_predict(tr, te, task="regression", adapter=OlsAdapter(index), weighted=True,
                      variant=variant)
    return p.select("query_id", r6("prediction").alias("prediction"))


@register("V1_context_regressor", _with(PART_SQL, _P_K1, _P_K2, _PAIRS1) + """
, fit AS (SELECT """ + ols_sql("dy", "bz") + """ FROM p1)""" + _a2("qz"))
def v1_context(spark, sf):
    """LR V1: interleaved layout; the adapter reads feature 1 (the case itself)."""
    return _variant(spark, sf, L.Variant(context=True), 1)


@register("V2_duplication_regressor", _with(PART_SQL, _P_K1, _P_K2, _PAIRS1, _WEIGHTS, _wls("dz"))
          + _a2("dz"))
def v2_duplication(spark, sf):
    """LR V2: each training pair counted ``c`` times (weighted fit, no row explosion)."""
    return _variant(spark, sf, L.Variant(duplicate=True), 0)


@register("V3_distance_column_regressor", _with(PART_SQL, _P_K1, _P_K2, _PAIRS1) + """
, fit AS (SELECT """ + ols_sql("dy", "dist") + """ FROM p1)""" + _a2("dist"))
def v3_distance_column(spark, sf):
    """LR V3: distance appended in both phases; the adapter reads the last feature."""
    return _variant(spark, sf, L.Variant(distance_column=True), -1)


@register("V123_combined_regressor", _with(PART_SQL, _P_K1, _P_K2, _PAIRS1, _WEIGHTS, _wls("dist"))
          + _a2("dist"))
def v123_combined(spark, sf):
    """V1 + V2 + V3: one layout ``interleave ++ [dist]``, weights travel with their row."""
    return _variant(spark, sf, L.Variant(context=True, duplicate=True, distance_column=True), -1)


_P_K1_3 = knn_sql("nn1", "tr", "tr", PART_D2, 3, True)
_P_K2_7 = knn_sql("nn2", "te", "tr", PART_D2, 7, False)


@register("U8_parameters", _with(PART_SQL, _P_K1_3, _P_K2_7, _PAIRS1) + f"""
, fit AS (SELECT {ols_sql("dy", "dz")} FROM p1)
SELECT query_id AS id, {sql_r6('avg(ny + s * dz + i)')} AS prediction FROM p2, fit GROUP BY query_id""")
def u8_parameters(spark, sf):
    """Reference parameter names are forwarded (k_fit=3, k_predict=7, unweighted)."""
    tr, te = part_cases(spark, sf)
    est = DifferenceRegressor(adapter="ols").set_params(
        n_neighbours_1=3, n_neighbours_2=7, weighted_knn=False)
    return est.fit(tr).predictions(te).select("id", r6("prediction").alias("prediction"))


@register("U7_custom_metric_estimator", _with(_DOC_SQL, _CV_SQL, _DOC_K1_CV, _DOC_K2_CV, _K7_SQL) + f"""
SELECT query_id AS id, {sql_r6('sum(v / (dist + 1e-8)) / sum(1.0 / (dist + 1e-8))')} AS prediction
FROM sc GROUP BY query_id""")
def u7_custom_metric(spark, sf):
    tr, te, _, spec = document_cases(spark, sf, "cvdhm")
    model = DifferenceRegressor(adapter="ols", spec=spec).fit(tr)
    return model.predictions(te).select("id", r6("prediction").alias("prediction"))


_LINEAR_PAIRS = """
dp1 AS (SELECT list_transform(list_zip(a.x, b.x), lambda p: p[1] - p[2]) AS x, a.y - b.y AS y
        FROM nn1 JOIN tr a ON a.id = nn1.query_id JOIN tr b ON b.id = nn1.neighbour_id),
dp2 AS (SELECT nn2.query_id, sqrt(nn2.d2) AS dist, b.y AS ny,
               list_transform(list_zip(q.x, b.x), lambda p: p[1] - p[2]) AS x
        FROM nn2 JOIN te q ON q.id = nn2.query_id JOIN tr b ON b.id = nn2.neighbour_id)"""


@register("U1_lr_linear", _with(PART_SQL, _P_K1, _P_K2, _LINEAR_PAIRS, ridge_sql("dp1")) + f"""
SELECT query_id AS id, {sql_r6('sum((1.0 / (dist + 1e-8)) * (ny + ' + score_sql("x") + ')) / sum(1.0 / (dist + 1e-8))')} AS prediction
FROM dp2, solved GROUP BY query_id""")
def u1_lr_linear(spark, sf):
    """LR with a ridge adapter on all difference features."""
    tr, te = part_cases(spark, sf)
    model = DifferenceRegressor(adapter=LinearAdapter()).fit(tr)
    return model.predictions(te).select("id", r6("prediction").alias("prediction"))


@register("U2_lc_mlp")
def u2_lc_mlp(spark, sf):
    """LC with a multilayer-perceptron adapter on the class difference (rows-only)."""
    from casediff.operators.adapters import MLClassAdapter
    tr, te = embedding_cases(spark, sf)
    est = DifferenceClassifier(adapter=MLClassAdapter(hidden_layer_sizes=(16,), max_iter=30))
    return est.fit(tr).predictions(te)


_E_K1 = knn_sql("en1", "etr", "etr", EMB_D2, K, True)
_E_K2 = knn_sql("en2", "ete", "etr", EMB_D2, K, False)
_EMB_DIFFS = """
ed1 AS (SELECT 0 AS g, list_transform(list_zip(a.x, b.x), lambda p: p[1] - p[2]) AS x, (a.y - b.y)::DOUBLE AS label
        FROM en1 JOIN etr a ON a.id = en1.query_id JOIN etr b ON b.id = en1.neighbour_id),
ed2 AS (SELECT 0 AS g, en2.query_id, en2.neighbour_id,
               list_transform(list_zip(q.x, b.x), lambda p: p[1] - p[2]) AS x
        FROM en2 JOIN ete q ON q.id = en2.query_id JOIN etr b ON b.id = en2.neighbour_id)"""


@register("L2_classifier_adapter", _with(EMB_SQL, _E_K1, _E_K2, _EMB_DIFFS, tree_sql("ed1"), tree_score_sql("ed2", "query_id, neighbour_id")) + """
SELECT query_id, neighbour_id, pred::DOUBLE AS dhat FROM scored""")
def l2_classifier_adapter(spark, sf):
    """L2 on its own: a tree on the differences gives a class difference for every query pair."""
    tr, te = embedding_cases(spark, sf)
    diffs = L.training_differences(tr, K).withColumn("dy", F.col("dy").cast("double"))
    a = L.fit_adapter(diffs, TreeAdapter())
    return L.scored_query_pairs(te, tr, K, a).select("query_id", "neighbour_id", "dhat")


# -- evaluation ---------------------------------------------------------------------

GRID = (1, 3, 5, 7)
_FOLD = f"{bucket_sql('id', 0)} % 10"
_CV = f"""
f AS (SELECT *, {_FOLD} AS fold FROM tr),
cv_all AS (SELECT a.id AS query_id, b.id AS neighbour_id, a.fold AS q_fold, a.y AS q_y, b.y AS n_y,
                  ({PART_D2}) AS d2
           FROM f a JOIN f b ON a.id <> b.id AND a.fold <> b.fold),
cv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rank_key_sql('d2')}, neighbour_id) AS rank
                      FROM cv_all) WHERE rank <= {max(GRID)}),
grid AS (SELECT unnest({list(GRID)}) AS k),
per_k AS (SELECT k, query_id, q_fold, q_y, avg(n_y) AS pred FROM cv JOIN grid ON rank <= k GROUP BY ALL),
per_fold AS (SELECT k, q_fold, -avg(abs(pred - q_y)) AS s FROM per_k GROUP BY ALL),
scores AS (SELECT k, avg(s) AS score FROM per_fold GROUP BY k),
best AS (SELECT k AS best_k FROM scores ORDER BY round(score, 9) DESC, k LIMIT 1)"""


@register("E1_cv_folds", _with(PART_SQL) + f"SELECT id, CAST({_FOLD} AS INTEGER) AS fold FROM tr")
def e1_folds(spark, sf):
    tr, _ = part_cases(spark, sf)
    return tr.select("id", fold_of("id", 10, 0).alias("fold"))


@register("E1_stratified_folds", _with(EMB_SQL) + f"""
SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {bucket_sql('id', 0)}, id) - 1) % 10 AS INTEGER) AS fold FROM etr""")
def e1_stratified(spark, sf):
    tr, _ = embedding_cases(spark, sf)
    return stratified_folds(tr, "y", 10, 0).select("id", "y", "fold")


def _cv_scores(spark, sf):
    tr, _ = part_cases(spark, sf)
    return E.cv_knn_scores(tr, GRID, task="regression", weighted=False, n_folds=10, seed=0)


@register("E2_grid_search_k", _with(PART_SQL, _CV) + f"""
SELECT CAST(k AS INTEGER) AS k, {sql_r5('score')} AS score FROM scores""")
def e2_grid(spark, sf):
    return _cv_scores(spark, sf).select("k", r5("score").alias("score"))


K_FIT = (1, 3, 5)
_STAGE_TWO = f"""
fv AS (SELECT range AS v FROM range(10)),
per_fold_nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, n_fold ORDER BY {rank_key_sql('d2')}, neighbour_id) AS fr
                FROM (SELECT a.id AS query_id, b.id AS neighbour_id, a.fold AS q_fold, b.fold AS n_fold, a.y AS q_y, b.y AS n_y,
                             a.z AS q_z, b.z AS n_z, ({PART_D2}) AS d2
                      FROM f a JOIN f b ON a.id <> b.id)) WHERE fr <= {max(GRID)}),
loo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY {rank_key_sql('d2')}, neighbour_id) AS rank
        FROM per_fold_nn JOIN fv ON n_fold <> v) WHERE rank <= {max(GRID)}),
lp AS (SELECT v, query_id, q_fold, q_y, n_y, rank, sqrt(d2) AS dist,
              unnest([{{'flag': 'plain', 'x': q_z - n_z}}, {{'flag': 'context', 'x': q_z}}, {{'flag': 'distance', 'x': sqrt(d2)}}]) AS s FROM loo),
kf AS (SELECT unnest({list(K_FIT)}) AS k_fit),
ls AS (SELECT v, s.flag AS flag, k_fit, count(*) AS n, sum(s.x) AS sx, sum(q_y - n_y) AS sy, sum(s.x * s.x) AS sxx,
              sum(s.x * (q_y - n_y)) AS sxy FROM lp JOIN kf ON rank <= k_fit WHERE q_fold <> v GROUP BY ALL),
lc AS (SELECT *, CASE WHEN n * sxx - sx * sx > 1e-9 * n * sxx THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0.0 END AS slope FROM ls),
lf AS (SELECT v, flag, k_fit, slope, (sy - slope * sx) / n AS icpt FROM lc),
lv AS (SELECT lp.v, query_id, q_y, k_fit, k AS k_predict, lf.flag, dist, n_y + slope * s.x + icpt AS value
       FROM lp JOIN lf ON lf.v = lp.v AND lf.flag = s.flag JOIN grid ON rank <= k WHERE q_fold = lp.v),
lq AS (SELECT v, query_id, q_y, k_fit, k_predict, flag,
              unnest([{{'w': FALSE, 'p': avg(value)}}, {{'w': TRUE, 'p': sum(value / (dist + 1e-8)) / sum(1.0 / (dist + 1e-8))}}]) AS m
       FROM lv GROUP BY v, query_id, q_y, k_fit, k_predict, flag),
lo AS (SELECT v, k_fit, k_predict, flag, m.w AS weighted, -avg(abs(m.p - q_y)) AS s FROM lq GROUP BY ALL)"""


@register("E3_two_stage_tuning", _with(PART_SQL, _CV, _STAGE_TWO) + f"""
SELECT best_k::INTEGER AS best_k, k_fit::INTEGER AS k_fit, k_predict::INTEGER AS k_predict, flag, weighted,
       {sql_r5('avg(s)')} AS score FROM lo, best GROUP BY ALL""")
def e3_two_stage(spark, sf):
    """Stage one tunes k of the kNN baseline (``best_k``); stage two scores the learner over kFit, kPredict (that k
    and the others of the grid), V1 / V3 and the weighting, in 10 folds."""
    tr, _ = part_cases(spark, sf)
    best = E.best_k(_cv_scores(spark, sf).withColumn("score", F.round("score", 9)))
    scores = E.cv_learner_scores(tr, K_FIT, GRID, n_folds=10, seed=0)
    return scores.select(F.lit(best).cast("int").alias("best_k"), F.col("k_fit").cast("int").alias("k_fit"),
                         F.col("k_predict").cast("int").alias("k_predict"), "flag", "weighted", r5("score").alias("score"))


_P_K2_MAX = knn_sql("nn2", "te", "tr", PART_D2, max(GRID), False)


@register("E4_refit_and_test", _with(PART_SQL, _CV, _P_K2_MAX) + f"""
SELECT CAST(best_k AS INTEGER) AS best_k, {sql_r5('-avg(abs(pred - y))')} AS test_neg_mae FROM (
  SELECT nn2.query_id, avg(b.y) AS pred, any_value(q.y) AS y, any_value(best_k) AS best_k
  FROM nn2 JOIN te q ON q.id = nn2.query_id JOIN tr b ON b.id = nn2.neighbour_id, best
  WHERE nn2.rank <= best_k GROUP BY nn2.query_id) GROUP BY best_k""")
def e4_refit(spark, sf):
    tr, te = part_cases(spark, sf)
    scores = _cv_scores(spark, sf).withColumn("score", F.round("score", 9))
    k = E.best_k(scores)
    p = L.knn_baseline(tr, te, k, task="regression", weighted=False)
    j = p.join(te.select(F.col("id").alias("query_id"), "y"), "query_id")
    return E.neg_mae(j, "prediction", "y").select(F.lit(k).cast("int").alias("best_k"),
                                                 r5("neg_mae").alias("test_neg_mae"))


SEEDS = (1, 2, 3)


def _seed_sql(s: int) -> str:
    b = f"({bucket_sql('p_partkey', s)} % 100)"
    return f"""
SELECT {s} AS seed, -avg(abs(pred - y)) AS neg_mae FROM (
  SELECT query_id, avg(ny) AS pred, any_value(qy) AS y FROM (
    SELECT a.id AS query_id, a.y AS qy, b.y AS ny,
           row_number() OVER (PARTITION BY a.id ORDER BY {rank_key_sql(PART_D2.replace('a.z', 'a.zz').replace('b.z', 'b.zz'))}, b.id) AS rank
    FROM (SELECT * FROM sp{s} WHERE bucket >= 80) a JOIN (SELECT * FROM sp{s} WHERE bucket < 80) b ON TRUE)
  WHERE rank <= {K} GROUP BY query_id)"""


def _seed_cte(s: int) -> str:
    b = f"({bucket_sql('p_partkey', s)} % 100)"
    return f"""
raw{s} AS (SELECT p_partkey AS id, p_size, p_type, p_retailprice AS y, {b} AS bucket FROM part),
st{s} AS (SELECT avg(p_size)::DOUBLE AS mu,
                 CASE WHEN stddev_pop(p_size) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(p_size)::DOUBLE END AS sd
          FROM raw{s} WHERE bucket < 80),
sp{s} AS (SELECT id, (p_size - mu) / sd AS zz, p_type, y, bucket FROM raw{s}, st{s})"""


_RUNS = "WITH " + ",".join(_seed_cte(s).strip() for s in SEEDS) + """
, runs AS (""" + " UNION ALL ".join(_seed_sql(s) for s in SEEDS) + ")"


def _runs(spark, sf):
    part = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_type", "p_retailprice")
    out = None
    for s in SEEDS:
        train, test = train_test_split(part, "p_partkey", 80, s)
        prep = fit_preparation(train, PART_SCHEMA)
        tr, te = prep.transform(train), prep.transform(test)
        p = L.knn_baseline(tr, te, K, task="regression", weighted=False)
        j = p.join(te.select(F.col("id").alias("query_id"), "y"), "query_id")
        r = E.neg_mae(j, "prediction", "y").select(F.lit(s).alias("seed"), "neg_mae")
        out = r if out is None else out.unionByName(r)
    return out


@register("E9_repeated_runs", _RUNS + f"""
SELECT seed, {sql_r5('neg_mae')} AS neg_mae FROM runs""")
def e9_repeats(spark, sf):
    """The kNN regression experiment repeated over split seeds (seeds as rows)."""
    return _runs(spark, sf).select("seed", r5("neg_mae").alias("neg_mae"))


@register("E9_mean_of_runs", _RUNS + f"""
SELECT count(*) AS n_runs, {sql_r5('avg(neg_mae)')} AS mean_neg_mae FROM runs""")
def e9_mean(spark, sf):
    """The score of the repeated experiment, averaged over the seeds."""
    return _runs(spark, sf).agg(F.count(F.lit(1)).alias("n_runs"), F.avg("neg_mae").alias("mean")).select(
        "n_runs", r5("mean").alias("mean_neg_mae"))


@register("B5_direct_model", _with(PART_SQL, ridge_sql("tr")) + f"""
SELECT id, {sql_r6(score_sql("x"))} AS prediction FROM te, solved""")
def b5_direct_model(spark, sf):
    """The linear adapter on raw features."""
    tr, te = part_cases(spark, sf)
    a = LinearAdapter().fit(tr, "x", "y")
    return a.score(te, "x").select("id", r6("dhat").alias("prediction"))


_PART_SEGMENTS = """
pq AS (SELECT quantile_cont(y, [0.0, 1.0 / 3, 2.0 / 3, 1.0]) AS e FROM tr),
b6 AS (SELECT 0 AS g, x, CAST(y >= e[1] AS INTEGER) + CAST(y >= e[2] AS INTEGER) + CAST(y >= e[3] AS INTEGER) AS label FROM tr, pq),
b6t AS (SELECT 0 AS g, id, x FROM te)"""


@register("B6_direct_on_segments", _with(PART_SQL, _PART_SEGMENTS, tree_sql("b6"), tree_score_sql("b6t", "id")) + """
SELECT id, pred::INTEGER AS segment FROM scored""")
def b6_direct_on_segments(spark, sf):
    """A tree on the equal-frequency segments of the target."""
    tr, te = part_cases(spark, sf)
    ef = EqualFrequency(3).fit(tr, "y")
    a = TreeAdapter().fit(tr.withColumn("seg", ef.segment("y")), "x", "seg")
    return a.score(te, "x").select("id", F.col("dhat").cast("int").alias("segment"))
