"""Registered queries: discretisation (T1-T3) and implicit learners
(K3-K6, D8, D9, A5, L3, L5, U3, U4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casediff.operators.discretise import EqualFrequency, EqualWidth
from casediff.operators.knn import knn_join, random_order
from casediff.operators.prep import train_test_split
from casediff.operators.adapters import TreeAdapter
from casediff.plans import implicit as I
from casediff.plans.implicit_estimators import ImplicitClassifier, ImplicitRegressor
from casediff.plans.learner_sql import tree_score_sql, tree_sql
from casediff.plans.cases import (EMB_D2, EMB_SQL, PART_D2, PART_SQL, bucket_sql,
                                  embedding_cases, knn_sql, part_cases, r6, sql_r6)
from casediff.plans.registry import _with, register
from casediff.sources.tables import read_table

N_PER_CLASS = 3
RANDOM_SEED = 7

# -- T1-T3 on customer.c_acctbal -----------------------------------------------


def _customer_split(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                                 F.col("c_acctbal").alias("y"))
    return train_test_split(c, "id", 80, 2)


_CUST = f"""
cu AS (SELECT c_custkey AS id, c_acctbal AS y, {bucket_sql('c_custkey')} % 100 AS bucket FROM customer),
ctr AS (SELECT * FROM cu WHERE bucket < 80),
cte AS (SELECT * FROM cu WHERE bucket >= 80),
mm AS (SELECT min(y) AS lo, max(y) AS hi, (max(y) - min(y)) / 3 AS w FROM ctr),
qe AS (SELECT quantile_cont(y, [0.0, 1.0 / 3, 2.0 / 3, 1.0]) AS e FROM ctr)"""


@register("T1_equal_width", _with(_CUST) + """
SELECT id, seg,
       CASE WHEN seg IS NULL THEN NULL ELSE
         CAST(CAST(trunc(lo + seg * w) AS BIGINT) AS VARCHAR) || '-' ||
         CAST(CAST(trunc(CASE WHEN seg = 2 THEN hi ELSE lo + (seg + 1) * w END) AS BIGINT) AS VARCHAR) END AS label
FROM (SELECT id, lo, hi, w,
             CASE WHEN y < lo OR y > hi THEN NULL
                  ELSE CAST(y >= lo + 1 * w AS INTEGER) + CAST(y >= lo + 2 * w AS INTEGER) END AS seg
      FROM cu, mm)""")
def t1_equal_width(spark, sf):
    tr, te = _customer_split(spark, sf)
    ew = EqualWidth(3).fit(tr, "y")
    both = tr.unionByName(te).withColumn("seg", ew.segment("y"))
    return both.select("id", "seg", ew.label("seg").alias("label"))


@register("T2_equal_frequency", _with(_CUST) + """
SELECT id, CAST(y >= e[1] AS INTEGER) + CAST(y >= e[2] AS INTEGER) + CAST(y >= e[3] AS INTEGER) AS seg
FROM ctr, qe""")
def t2_equal_frequency(spark, sf):
    tr, _ = _customer_split(spark, sf)
    ef = EqualFrequency(3).fit(tr, "y")
    return tr.select("id", ef.segment("y").alias("seg"))


@register("T3_apply_fitted_edges", _with(_CUST) + """
SELECT id, CAST(y >= e[1] AS INTEGER) + CAST(y >= e[2] AS INTEGER) + CAST(y >= e[3] AS INTEGER) AS seg
FROM cte, qe""")
def t3_apply(spark, sf):
    tr, te = _customer_split(spark, sf)
    ef = EqualFrequency(3).fit(tr, "y")
    return te.select("id", ef.segment("y").alias("seg"))


# -- implicit on embeddings ---------------------------------------------------

_E_K1_1 = knn_sql("p1", "etr", "etr", EMB_D2, 1, True)
_POOLS = """
pool AS (SELECT id, x, y AS cls FROM etr WHERE id IN (SELECT neighbour_id FROM p1))"""
_E_K4 = knn_sql("k4", "ete", "pool", EMB_D2, N_PER_CLASS, False, partition="cls")
_E_K5 = knn_sql("k5", "ete", "pool", EMB_D2, 1, False, partition="cls")


def _mix(v: str) -> str:
    return f"((({v}) % 2147483647) * 182605794 % 2147483647)"


_H = _mix(f"xor({_mix(f'{RANDOM_SEED} + a.id')}, b.id % 2147483647)")
_RAND = f"CAST({_mix(f'xor({_H}, {_H} >> 15)')} AS DOUBLE)"
_E_K6 = knn_sql("k6", "ete", "pool", _RAND, N_PER_CLASS, False, partition="cls")


@register("K3_one_nn_pairs", _with(EMB_SQL, _E_K1_1) + f"""
SELECT query_id, neighbour_id, {sql_r6('sqrt(d2)')} AS dist FROM p1""")
def k3_one_nn(spark, sf):
    tr, _ = embedding_cases(spark, sf)
    nb = knn_join(tr, tr, 1, exclude_self=True)
    return nb.select("query_id", "neighbour_id", r6("dist").alias("dist"))


@register("D8_case_pairs", _with(EMB_SQL, _E_K1_1) + f"""
SELECT src_id, target_id, CAST(pos AS INTEGER) AS pos, {sql_r6('pair[pos + 1]')} AS v FROM (
  SELECT p1.neighbour_id AS src_id, p1.query_id AS target_id, list_concat(b.x, a.x) AS pair,
         unnest(range(2 * len(a.x))) AS pos
  FROM p1 JOIN etr a ON a.id = p1.query_id JOIN etr b ON b.id = p1.neighbour_id)""")
def d8_case_pairs(spark, sf):
    tr, _ = embedding_cases(spark, sf)
    pairs = I.case_pairs(tr)
    return pairs.select("src_id", "target_id", F.posexplode("pair")).select(
        "src_id", "target_id", "pos", r6("col").alias("v"))


@register("D9_pairs_by_class", _with(EMB_SQL, _E_K1_1) + """
SELECT b.y AS src_class, count(*) AS n_pairs, count(DISTINCT p1.neighbour_id) AS n_pool
FROM p1 JOIN etr b ON b.id = p1.neighbour_id GROUP BY b.y""")
def d9_by_class(spark, sf):
    tr, _ = embedding_cases(spark, sf)
    pairs = I.case_pairs(tr)
    return pairs.groupBy("src_class").agg(F.count(F.lit(1)).alias("n_pairs"),
                                          F.countDistinct("src_id").alias("n_pool"))


def _implicit(spark, sf, **kw):
    tr, te = embedding_cases(spark, sf)
    return I.fit_implicit(tr, n_neighbours=N_PER_CLASS, **kw), te


@register("K4_class_knn", _with(EMB_SQL, _E_K1_1, _POOLS, _E_K4) + f"""
SELECT query_id, cls, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM k4""")
def k4_class_knn(spark, sf):
    m, te = _implicit(spark, sf)
    c = m.candidates(te)
    return c.select("query_id", "cls", "neighbour_id", "rank", r6("dist").alias("dist"))


@register("K5_single_per_class", _with(EMB_SQL, _E_K1_1, _POOLS, _E_K5) + f"""
SELECT query_id, cls, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM k5""")
def k5_single(spark, sf):
    m, te = _implicit(spark, sf, single_pair=True)
    c = m.candidates(te)
    return c.select("query_id", "cls", "neighbour_id", "rank", r6("dist").alias("dist"))


@register("K6_random_per_class", _with(EMB_SQL, _E_K1_1, _POOLS, _E_K6) + """
SELECT query_id, cls, neighbour_id, rank FROM k6""")
def k6_random(spark, sf):
    """Random order of all pairs by a hash (the sampled form is ``K6_random_positions``)."""
    m, te = _implicit(spark, sf)
    c = knn_join(te, m.pools, N_PER_CLASS, by="cls", spec=random_order(RANDOM_SEED))
    return c.select("query_id", "cls", "neighbour_id", "rank")


@register("K6_random_positions", _with(EMB_SQL, _E_K1_1, _POOLS) + f"""
, np AS (SELECT id, cls, row_number() OVER (PARTITION BY cls ORDER BY {bucket_sql('id', RANDOM_SEED)}, id) - 1 AS pos,
                count(*) OVER (PARTITION BY cls) AS n FROM pool),
nc AS (SELECT cls, max(n) AS n FROM np GROUP BY cls),
dr AS (SELECT q.id AS query_id, cls, j + 1 AS rank, ({bucket_sql('q.id', RANDOM_SEED)} + j) % n AS pos
       FROM ete q, nc, range({N_PER_CLASS}) t(j) WHERE j < n)
SELECT dr.query_id, dr.cls, np.id AS neighbour_id, dr.rank::INTEGER AS rank FROM dr JOIN np ON np.cls = dr.cls AND np.pos = dr.pos""")
def k6_positions(spark, sf):
    """Random cases per class by position: work is N a class and query."""
    m, te = _implicit(spark, sf, random_pairs=True, seed=RANDOM_SEED)
    return m.candidates(te).select("query_id", "cls", "neighbour_id", "rank")


_MODES = """
modes AS (SELECT cls, label AS mode_label FROM (
  SELECT b.y AS cls, a.y AS label, row_number() OVER (PARTITION BY b.y ORDER BY count(*) DESC, a.y) AS o
  FROM p1 JOIN etr a ON a.id = p1.query_id JOIN etr b ON b.id = p1.neighbour_id
  GROUP BY b.y, a.y) WHERE o = 1)"""

_L5 = """
l5 AS (SELECT k4.query_id, k4.cls, k4.rank, modes.mode_label AS pred FROM k4 JOIN modes USING (cls))"""


@register("L5_per_class_scoring", _with(EMB_SQL, _E_K1_1, _POOLS, _E_K4, _MODES, _L5) + """
SELECT query_id, cls, rank, pred FROM l5""")
def l5_per_class_scoring(spark, sf):
    m, te = _implicit(spark, sf)
    return m.score(te).select("query_id", "cls", "rank", "pred")


_A5 = """
SELECT query_id, pred AS prediction FROM (
  SELECT query_id, pred, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, o) AS r FROM (
    SELECT query_id, pred, count(*) AS c, min(cls * 1000000 + rank) AS o FROM l5 GROUP BY ALL))
WHERE r = 1"""


@register("A5_implicit_vote", _with(EMB_SQL, _E_K1_1, _POOLS, _E_K4, _MODES, _L5) + _A5)
def a5_implicit_vote(spark, sf):
    m, te = _implicit(spark, sf)
    return m.predict(te)


@register("U3_implicit_classifier", _with(EMB_SQL, _E_K1_1, _POOLS, _E_K4, _MODES, _L5) + _A5)
def u3_implicit(spark, sf):
    tr, te = embedding_cases(spark, sf)
    model = ImplicitClassifier(nNeighbours=N_PER_CLASS, adapter="mode").fit(tr)
    return model.predictions(te).select(F.col("id").alias("query_id"), "prediction")


_PAIR_ROWS = """
prs AS (SELECT b.y AS g, list_concat(b.x, a.x) AS x, a.y AS label
        FROM p1 JOIN etr a ON a.id = p1.query_id JOIN etr b ON b.id = p1.neighbour_id)"""
_PAIR_CANDIDATES = """
prc AS (SELECT k4.cls AS g, k4.query_id, k4.rank, list_concat(pool.x, q.x) AS x
        FROM k4 JOIN ete q ON q.id = k4.query_id JOIN pool ON pool.id = k4.neighbour_id)"""
_TREE_VOTE = """
SELECT query_id, pred AS prediction FROM (
  SELECT query_id, pred, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, o) AS r FROM (
    SELECT query_id, pred, count(*) AS c, min(g * 1000000 + rank) AS o FROM scored GROUP BY query_id, pred))
WHERE r = 1"""


@register("L3_per_class_models", _with(EMB_SQL, _E_K1_1, _POOLS, _E_K4, _PAIR_ROWS, _PAIR_CANDIDATES, tree_sql("prs"),
                                       tree_score_sql("prc", "query_id, g, rank")) + _TREE_VOTE)
def l3_per_class_models(spark, sf):
    """U3 with one tree per source class, all fitted and scored at once."""
    m, te = _implicit(spark, sf, adapter="tree")
    return m.predict(te)


# -- U4: implicit regressor on part (target in 3 equal-frequency segments) --------

_PART_SEG = """
pq AS (SELECT quantile_cont(y, [0.0, 1.0 / 3, 2.0 / 3, 1.0]) AS e FROM tr),
trs AS (SELECT tr.id, tr.z, tr.p_type,
               CAST(y >= e[1] AS INTEGER) + CAST(y >= e[2] AS INTEGER) + CAST(y >= e[3] AS INTEGER) AS y
        FROM tr, pq)"""
_P_K1_1 = knn_sql("pp1", "trs", "trs", PART_D2, 1, True)
_P_POOL = """
ppool AS (SELECT id, z, p_type, y AS cls FROM trs WHERE id IN (SELECT neighbour_id FROM pp1))"""
_P_K4 = knn_sql("pk4", "te", "ppool", PART_D2, N_PER_CLASS, False, partition="cls")


@register("U4_implicit_regressor", _with(PART_SQL, _PART_SEG, _P_K1_1, _P_POOL, _P_K4) + """
, modes AS (SELECT cls, label AS mode_label FROM (
  SELECT b.y AS cls, a.y AS label, row_number() OVER (PARTITION BY b.y ORDER BY count(*) DESC, a.y) AS o
  FROM pp1 JOIN trs a ON a.id = pp1.query_id JOIN trs b ON b.id = pp1.neighbour_id
  GROUP BY b.y, a.y) WHERE o = 1),
l5 AS (SELECT pk4.query_id, pk4.cls, pk4.rank, modes.mode_label AS pred FROM pk4 JOIN modes USING (cls))
""" + _A5)
def u4_implicit_regressor(spark, sf):
    tr, te = part_cases(spark, sf)
    model = ImplicitRegressor(nNeighbours=N_PER_CLASS, adapter="mode", nSegments=3).fit(tr)
    return model.predictions(te).select(F.col("id").alias("query_id"), "prediction")


# -- report-only variants R0-R5 (embeddings) ------------------------------------------

_E_Q1 = knn_sql("q1", "ete", "etr", EMB_D2, 1, False)
_R0 = """
pairs AS (SELECT p1.query_id AS pid, b.y AS grp, list_concat(b.x, a.x) AS x, a.y AS label
          FROM p1 JOIN etr a ON a.id = p1.query_id JOIN etr b ON b.id = p1.neighbour_id),
qp AS (SELECT q1.query_id AS id, n.y AS grp, list_concat(n.x, q.x) AS x
       FROM q1 JOIN ete q ON q.id = q1.query_id JOIN etr n ON n.id = q1.neighbour_id)"""
_R0_NN = knn_sql("r0", "qp", "(SELECT pid AS id, grp, x, label FROM pairs)", EMB_D2, 1, False,
                 extra_pred="a.grp = b.grp")


@register("R0_nearest_pair_in_class", _with(EMB_SQL, _E_K1_1, _E_Q1, _R0, _R0_NN) + """
SELECT r0.query_id, pairs.label AS prediction FROM r0 JOIN pairs ON pairs.pid = r0.neighbour_id""")
def r0_nearest_pair(spark, sf):
    tr, te = embedding_cases(spark, sf)
    return I.predict_nearest_pair(tr, te)


_POOL_NN = knn_sql("pn", "ete", "pool", EMB_D2, N_PER_CLASS, False)


@register("R3_nearest_case_picks_adapter", _with(EMB_SQL, _E_K1_1, _POOLS, _POOL_NN, _MODES) + """
SELECT pn.query_id, modes.mode_label AS prediction
FROM pn JOIN pool ON pool.id = pn.neighbour_id JOIN modes ON modes.cls = pool.cls WHERE pn.rank = 1""")
def r3_nearest_case(spark, sf):
    m, te = _implicit(spark, sf)
    return I.predict_by_nearest_class(m, te, 1)


@register("R4_n_nearest_cases_vote", _with(EMB_SQL, _E_K1_1, _POOLS, _POOL_NN, _MODES) + """
SELECT query_id, pred AS prediction FROM (
  SELECT query_id, pred, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, r) AS o FROM (
    SELECT pn.query_id, modes.mode_label AS pred, count(*) AS c, min(pn.rank) AS r
    FROM pn JOIN pool ON pool.id = pn.neighbour_id JOIN modes ON modes.cls = pool.cls
    GROUP BY ALL)) WHERE o = 1""")
def r4_n_nearest(spark, sf):
    m, te = _implicit(spark, sf)
    return I.predict_by_nearest_class(m, te, N_PER_CLASS)


_L5_SINGLE = """
l5 AS (SELECT k5.query_id, k5.cls, k5.rank, modes.mode_label AS pred FROM k5 JOIN modes USING (cls))"""


@register("R5_one_per_class_vote", _with(EMB_SQL, _E_K1_1, _POOLS, _E_K5, _MODES, _L5_SINGLE) + _A5)
def r5_one_per_class(spark, sf):
    m, te = _implicit(spark, sf, single_pair=True)
    return m.predict(te)


_E_QN = knn_sql("qn", "ete", "etr", EMB_D2, N_PER_CLASS, False)


def _r_sql(with_class: bool) -> str:
    more = ", [(b.y)::DOUBLE]" if with_class else ", []::DOUBLE[]"
    return f"""
rp AS (SELECT 0 AS g, list_concat(list_concat(b.x, a.x){more}) AS x, a.y AS label
       FROM p1 JOIN etr a ON a.id = p1.query_id JOIN etr b ON b.id = p1.neighbour_id),
rq AS (SELECT 0 AS g, qn.query_id, qn.rank, list_concat(list_concat(b.x, q.x){more}) AS x
       FROM qn JOIN ete q ON q.id = qn.query_id JOIN etr b ON b.id = qn.neighbour_id)"""


_R_VOTE = """
SELECT query_id, pred AS prediction FROM (
  SELECT query_id, pred, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, o) AS r FROM (
    SELECT query_id, pred, count(*) AS c, min(rank) AS o FROM scored GROUP BY query_id, pred))
WHERE r = 1"""


def _r_query(with_class: bool) -> str:
    return _with(EMB_SQL, _E_K1_1, _E_QN, _r_sql(with_class), tree_sql("rp"), tree_score_sql("rq", "query_id, rank")) + _R_VOTE


@register("R1_pair_classifier", _r_query(False))
def r1_pair_classifier(spark, sf):
    """One classifier, a tree, on ``[neighbour : base]``."""
    tr, te = embedding_cases(spark, sf)
    a = I.fit_pair_classifier(tr, adapter=TreeAdapter())
    return I.predict_pair_classifier(a, tr, te, N_PER_CLASS)


@register("R2_pair_classifier_with_class", _r_query(True))
def r2_pair_classifier_class(spark, sf):
    """As R1 with the neighbour's class as an extra feature."""
    tr, te = embedding_cases(spark, sf)
    a = I.fit_pair_classifier(tr, with_class=True, adapter=TreeAdapter())
    return I.predict_pair_classifier(a, tr, te, N_PER_CLASS, with_class=True)
