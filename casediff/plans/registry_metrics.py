"""Registered queries: nominal/mixed metrics (M2-M8) and kNN under them (K7, K8).

Case base: ``documents`` joined with ``labels``; numeric ``n_chars``
(standardised), nominal ``lang`` and ``source``, class ``quality``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from casediff.operators import vdm as M
from casediff.operators.adapters import OlsAdapter
from casediff.operators.knn import knn_join
from casediff.operators.prep import fit_numeric_stats, train_test_split
from casediff.plans import learner as L
from casediff.plans.cases import K, bucket_sql, knn_sql, ols_sql, r6, sql_r6
from casediff.plans.registry import _with, register
from casediff.sources.tables import read_table

NOMINAL = ("lang", "source")
LABEL = "quality"


def document_cases(spark, sf, metric: str = "hvdm"):
    """``(train, test, encoding, spec)``; rows carry id, x=[z], codes, y and raw features."""
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, sf, "labels").select("doc_id", LABEL)
    dl = docs.join(labels, "doc_id").withColumnRenamed("doc_id", "id")
    tr, te = train_test_split(dl, "id", 80, 2)
    mean, std = fit_numeric_stats(tr, ["n_chars"])["n_chars"]
    if metric is None:          # lookup-only queries: no kernel spec needed
        enc, spec = None, None
    elif metric == "hvdm":
        enc, spec = M.hvdm_spec(tr, NOMINAL, LABEL)
    else:
        enc, spec = M.cvdhm_spec(tr, NOMINAL, LABEL, final="half" if metric == "cvdhm_half" else "sqrt")

    def shape(df):
        zn = (F.col("n_chars").cast("double") - F.lit(mean)) / F.lit(std)
        codes = [enc.codes().alias("codes")] if enc is not None else []
        return df.select("id", F.array(zn).alias("x"), *codes,
                         F.col(LABEL).alias("y"), zn.alias("zn"), "lang", "source")

    return shape(tr), shape(te), enc, spec


_DOC_SQL = f"""
dl AS (SELECT d.doc_id AS id, d.lang, d.source, d.n_chars, l.quality,
              {bucket_sql('d.doc_id')} % 100 AS bucket
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
ds AS (SELECT avg(n_chars)::DOUBLE AS mu,
              CASE WHEN stddev_pop(n_chars) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(n_chars)::DOUBLE END AS sd
       FROM dl WHERE bucket < 80),
dz AS (SELECT id, lang, source, quality AS y, (n_chars - mu) / sd AS z, bucket FROM dl, ds),
dtr AS (SELECT * FROM dz WHERE bucket < 80),
dte AS (SELECT * FROM dz WHERE bucket >= 80),
vc AS (SELECT 'lang' AS feature, lang AS value, CAST(y AS VARCHAR) AS cls FROM dtr
       UNION ALL SELECT 'source', source, CAST(y AS VARCHAR) FROM dtr),
cnt AS (SELECT feature, value, cls, count(*) AS n FROM vc WHERE value IS NOT NULL GROUP BY ALL),
ncls AS (SELECT cls, count(*) AS nc FROM (SELECT CAST(y AS VARCHAR) AS cls FROM dtr) GROUP BY cls),
vals AS (SELECT DISTINCT feature, value FROM cnt)"""

# VDM: P(class | value), dense over the classes.
_VDM_SQL = """
tot AS (SELECT feature, value, sum(n) AS nv FROM cnt GROUP BY ALL),
vd AS (SELECT t.feature, t.value, c.cls, coalesce(cnt.n, 0) / t.nv AS p
       FROM tot t CROSS JOIN ncls c
       LEFT JOIN cnt ON cnt.feature = t.feature AND cnt.value = t.value AND cnt.cls = c.cls),
vdm AS (SELECT a.feature, a.value AS v1, b.value AS v2, sum((a.p - b.p) * (a.p - b.p)) AS d2
        FROM vd a JOIN vd b ON a.feature = b.feature AND a.cls = b.cls GROUP BY ALL)"""

# CVDHM: P(value | class), dense over the classes.
_CV_SQL = """
cd AS (SELECT v.feature, v.value, c.cls, coalesce(cnt.n, 0) / c.nc AS p
       FROM vals v CROSS JOIN ncls c
       LEFT JOIN cnt ON cnt.feature = v.feature AND cnt.value = v.value AND cnt.cls = c.cls),
cv AS (SELECT a.feature, a.value AS v1, b.value AS v2,
              CASE WHEN a.value = b.value THEN 0.0
                   WHEN sum(a.p + b.p) = 0 THEN 0.0
                   ELSE sum(abs(a.p - b.p)) / sum(a.p + b.p) END AS d
       FROM cd a JOIN cd b ON a.feature = b.feature AND a.cls = b.cls
       GROUP BY a.feature, a.value, b.value)"""

_NCLS = "(SELECT count(*) FROM ncls)"

_HVDM_D2 = f"""(a.z - b.z) * (a.z - b.z)
  + coalesce((SELECT d2 FROM vdm WHERE feature = 'lang' AND v1 = a.lang AND v2 = b.lang), {_NCLS})
  + coalesce((SELECT d2 FROM vdm WHERE feature = 'source' AND v1 = a.source AND v2 = b.source), {_NCLS})"""


def _cv_term(f: str) -> str:
    return (f"power(CASE WHEN a.{f} IS NULL OR b.{f} IS NULL THEN 1.0 WHEN a.{f} = b.{f} THEN 0.0 "
            f"ELSE coalesce((SELECT d FROM cv WHERE feature = '{f}' AND v1 = a.{f} AND v2 = b.{f}), 1.0) END, 2)")


_CV_SUM = ("power(CASE WHEN a.z IS NULL OR b.z IS NULL THEN 1.0 ELSE least(1.0, abs(a.z - b.z)) END, 2) + "
           + _cv_term("lang") + " + " + _cv_term("source"))


@register("M2_vdm", _with(_DOC_SQL, _VDM_SQL) + f"""
SELECT feature, v1, v2, {sql_r6('sqrt(d2)')} AS d FROM vdm""")
def m2_vdm(spark, sf):
    tr, _, _, _ = document_cases(spark, sf, None)
    lk = M.vdm_lookup(tr.withColumnRenamed("y", LABEL), NOMINAL, LABEL)
    return lk.select("feature", "v1", "v2", r6("d").alias("d"))


_DOC_K2_HVDM = knn_sql("hn", "dte", "dtr", _HVDM_D2, K, False)


@register("M3_hvdm_knn", _with(_DOC_SQL, _VDM_SQL, _DOC_K2_HVDM) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM hn""")
def m3_hvdm_knn(spark, sf):
    tr, te, _, spec = document_cases(spark, sf, "hvdm")
    nb = knn_join(te, tr, K, spec=spec)
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


@register("M4_cvdhm_value_distance", _with(_DOC_SQL, _CV_SQL) + f"""
SELECT feature, v1, v2, {sql_r6('d')} AS d FROM cv WHERE v1 <> v2""")
def m4_cvdhm(spark, sf):
    tr, _, _, _ = document_cases(spark, sf, None)
    lk = M.cvdhm_lookup(tr.withColumnRenamed("y", LABEL), NOMINAL, LABEL)
    return lk.where(F.col("v1") != F.col("v2")).select("feature", "v1", "v2", r6("d").alias("d"))


@register("M8_cvdhm_lookup", _with(_DOC_SQL, _CV_SQL) + f"""
SELECT feature, v1, v2, {sql_r6('d')} AS d FROM cv""")
def m8_lookup(spark, sf):
    tr, _, _, _ = document_cases(spark, sf, None)
    lk = M.cvdhm_lookup(tr.withColumnRenamed("y", LABEL), NOMINAL, LABEL)
    return lk.select("feature", "v1", "v2", r6("d").alias("d"))


_DOC_K2_CV = knn_sql("cn", "dte", "dtr", _CV_SUM, K, False)


@register("M5_feature_distance", _with(_DOC_SQL, _CV_SQL, _DOC_K2_CV) + f"""
SELECT cn.query_id, cn.neighbour_id, f.feature, {sql_r6('f.d')} AS d
FROM cn JOIN dte a ON a.id = cn.query_id JOIN dtr b ON b.id = cn.neighbour_id,
LATERAL (SELECT 'zn' AS feature,
                CASE WHEN a.z IS NULL OR b.z IS NULL THEN 1.0 ELSE least(1.0, abs(a.z - b.z)) END AS d
         UNION ALL SELECT 'lang', CASE WHEN a.lang = b.lang THEN 0.0 ELSE
                coalesce((SELECT d FROM cv WHERE feature = 'lang' AND v1 = a.lang AND v2 = b.lang), 1.0) END
         UNION ALL SELECT 'source', CASE WHEN a.source = b.source THEN 0.0 ELSE
                coalesce((SELECT d FROM cv WHERE feature = 'source' AND v1 = a.source AND v2 = b.source), 1.0) END) f""")
def m5_feature_distance(spark, sf):
    tr, te, _, spec = document_cases(spark, sf, "cvdhm")
    lk = M.cvdhm_lookup(tr.withColumnRenamed("y", LABEL), NOMINAL, LABEL)
    raw = ["zn", "lang", "source"]
    pairs = knn_join(te, tr, K, spec=spec, carry=[(f"n_{c}", c) for c in raw],
                     keep=[(f"q_{c}", c) for c in raw])
    fd = M.feature_distances(pairs, ["zn"], list(NOMINAL), lk)
    return fd.select("query_id", "neighbour_id", "feature", r6("d").alias("d"))


@register("M6_case_distance_half", _with(_DOC_SQL, _CV_SQL, _DOC_K2_CV) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('d2 / 2')} AS dist FROM cn""")
def m6_half(spark, sf):
    tr, te, _, spec = document_cases(spark, sf, "cvdhm_half")
    nb = knn_join(te, tr, K, spec=spec)
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


@register("M7_case_distance_root", _with(_DOC_SQL, _CV_SQL, _DOC_K2_CV) + f"""
SELECT query_id, neighbour_id, rank, {sql_r6('sqrt(d2)')} AS dist FROM cn""")
def m7_root(spark, sf):
    tr, te, _, spec = document_cases(spark, sf, "cvdhm")
    nb = knn_join(te, tr, K, spec=spec, strategy="tiles")
    return nb.select("query_id", "neighbour_id", "rank", r6("dist").alias("dist"))


_DOC_K1_CV = knn_sql("cn1", "dtr", "dtr", _CV_SUM, K, True)

_K7_SQL = """
fit AS (SELECT """ + ols_sql("a.y - b.y", "a.z - b.z") + """
        FROM cn1 JOIN dtr a ON a.id = cn1.query_id JOIN dtr b ON b.id = cn1.neighbour_id),
sc AS (SELECT cn.query_id, sqrt(cn.d2) AS dist, b.y + (s * (q.z - b.z) + i) AS v
       FROM cn JOIN dte q ON q.id = cn.query_id JOIN dtr b ON b.id = cn.neighbour_id, fit)"""


@register("K7_custom_metric_regressor", _with(_DOC_SQL, _CV_SQL, _DOC_K1_CV, _DOC_K2_CV, _K7_SQL) + f"""
SELECT query_id, {sql_r6('sum(v / (dist + 1e-8)) / sum(1.0 / (dist + 1e-8))')} AS prediction
FROM sc GROUP BY query_id""")
def k7_custom_metric(spark, sf):
    tr, te, _, spec = document_cases(spark, sf, "cvdhm")
    p = L.fit_predict(tr, te, task="regression", adapter=OlsAdapter(0), weighted=True, spec=spec)
    return p.select("query_id", r6("prediction").alias("prediction"))


@register("K8_custom_metric_classifier", _with(_DOC_SQL, _CV_SQL, _DOC_K2_CV) + """
, vp AS (SELECT cn.query_id, b.y AS ny FROM cn JOIN dtr b ON b.id = cn.neighbour_id)
SELECT query_id, ny AS prediction FROM (
  SELECT query_id, ny, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, ny) AS o
  FROM (SELECT query_id, ny, count(*) AS c FROM vp GROUP BY ALL)) WHERE o = 1""")
def k8_custom_metric_classifier(spark, sf):
    tr, te, _, spec = document_cases(spark, sf, "cvdhm")
    return L.knn_baseline(tr, te, K, task="classification", weighted=False, spec=spec)
