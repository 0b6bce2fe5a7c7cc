"""Registered queries: sources and sinks (S1-S6), preparation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casediff.operators import prep as P
from casediff.operators import vote as V
from casediff.plans.cases import (EMB_SQL, PART_SQL, bucket_sql, embedding_cases, part_cases,
                                  r6, sql_r6)
from casediff.plans.registry import _with, register
from casediff.session import scratch_path
from casediff.sources import csv as C
from casediff.sources.images import pseudo_image
from casediff.sources.sinks import append_metrics
from casediff.sources.tables import read_parquet, read_table

_CUSTOMER_TYPES = [T.LongType(), T.StringType(), T.IntegerType(), T.DoubleType(), T.StringType()]
_CUSTOMER_NAMES = ["cust_id", "name", "nation", "balance", "segment"]
_CUSTOMER_SQL = ("SELECT c_custkey AS cust_id, c_name AS name, c_nationkey AS nation, "
                 "c_acctbal AS balance, c_mktsegment AS segment FROM customer")


def _customer(spark, sf):
    return read_table(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


# -- sources and sinks --------------------------------------------------------


@register("S1_csv_header", _CUSTOMER_SQL)
def s1_csv_header(spark, sf):
    path = scratch_path(spark, "customer-csv-header")
    P.rename_by_position(_customer(spark, sf), _CUSTOMER_NAMES).write.option("header", True).csv(path)
    schema = T.StructType([T.StructField(n, t) for n, t in zip(_CUSTOMER_NAMES, _CUSTOMER_TYPES)])
    return C.read_csv(spark, path, schema, header=True)


@register("S2_csv_by_position", _CUSTOMER_SQL)
def s2_csv_by_position(spark, sf):
    path = scratch_path(spark, "customer-csv-noheader")
    _customer(spark, sf).write.option("header", False).csv(path)
    return C.read_csv_by_position(spark, path, _CUSTOMER_NAMES, _CUSTOMER_TYPES)


@register("S3_csv_row_id", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
def s3_csv_row_id(spark, sf):
    path = scratch_path(spark, "customer-csv-rowid")
    _customer(spark, sf).select("c_custkey", "c_acctbal").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("balance", T.DoubleType())])
    return C.read_csv_with_row_id(spark, path, schema, header=True)


@register("S4_parquet_case_base", _with(PART_SQL) + f"""
SELECT id, CAST(len(x) AS INTEGER) AS width, {sql_r6('list_sum(x)')} AS x_sum, y FROM pz""")
def s4_parquet_case_base(spark, sf):
    tr, te = part_cases(spark, sf)
    path = scratch_path(spark, "part-case-base")
    tr.unionByName(te).write.parquet(path)
    cb = read_parquet(spark, path)
    return cb.select("id", F.size("x").alias("width"),
                     r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("x_sum"), "y")


@register("S6_metrics_sink", _with(EMB_SQL) + """
SELECT run, 'class_count' AS metric, CAST(y AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS value
FROM e, (SELECT unnest([1, 2]) AS run) GROUP BY run, y""")
def s6_metrics_sink(spark, sf):
    counts = V.class_counts(read_table(spark, sf, "embeddings").withColumnRenamed("label", "y"), "y")
    path = scratch_path(spark, "metrics")
    for run in (1, 2):
        append_metrics(counts.select(F.lit(run).alias("run"), F.lit("class_count").alias("metric"),
                                     F.col("y").cast("string").alias("label"),
                                     F.col("n").cast("double").alias("value")), path, run_id=str(run))
    schema = "run INT, metric STRING, label STRING, value DOUBLE"
    return spark.read.schema(schema).json(path).select("run", "metric", "label", "value")


# -- preparation --------------------------------------------------------------


@register("P1_rename_by_position", _CUSTOMER_SQL)
def p1_rename(spark, sf):
    return P.rename_by_position(_customer(spark, sf), _CUSTOMER_NAMES)


@register("P2_select_roles", "SELECT p_partkey, p_size, p_type, p_retailprice FROM part")
def p2_select(spark, sf):
    from casediff.plans.cases import PART_SCHEMA
    return P.select_roles(read_table(spark, sf, "part"), PART_SCHEMA)


_EVENTS_NULLED = ("SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL "
                  "ELSE value END AS value FROM events")


def _events_nulled(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", "event_type",
                     F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value"))
                     .alias("value"))


@register("P3_drop_incomplete", f"SELECT event_id, value FROM ({_EVENTS_NULLED}) WHERE value IS NOT NULL")
def p3_dropna(spark, sf):
    return P.drop_incomplete(_events_nulled(spark, sf), ["value"]).select("event_id", "value")


@register("P4_range_filter", """
SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND p_retailprice < 950""")
def p4_range(spark, sf):
    part = read_table(spark, sf, "part")
    f = P.range_filter(P.range_filter(part, "p_size", 10, 40), "p_retailprice", hi=950)
    return f.select("p_partkey")


@register("P5_seeded_order", f"SELECT c_custkey AS id, {bucket_sql('c_custkey')} AS sort_key FROM customer")
def p5_seeded_order(spark, sf):
    c = read_table(spark, sf, "customer")
    ordered = P.seeded_order(c, "c_custkey", 2)
    return ordered.select(F.col("c_custkey").alias("id"), P.seeded_hash("c_custkey", 2).alias("sort_key"))


@register("P6_split", f"""
SELECT p_partkey AS id, CASE WHEN {bucket_sql('p_partkey')} % 100 < 80 THEN 'train' ELSE 'test' END AS split
FROM part""")
def p6_split(spark, sf):
    part = read_table(spark, sf, "part")
    tr, te = P.train_test_split(part, "p_partkey", 80, 2)
    return tr.select(F.col("p_partkey").alias("id"), F.lit("train").alias("split")).unionByName(
        te.select(F.col("p_partkey").alias("id"), F.lit("test").alias("split")))


@register("P7_mean_impute", f"""
SELECT event_id, {sql_r6('coalesce(value, (SELECT avg(value) FROM (' + _EVENTS_NULLED + ')))')} AS value
FROM ({_EVENTS_NULLED})""")
def p7_mean_impute(spark, sf):
    ev = _events_nulled(spark, sf)
    mean, _ = P.fit_numeric_stats(ev, ["value"])["value"]
    return ev.select("event_id", r6(F.coalesce(F.col("value"), F.lit(mean))).alias("value"))


_CUST_NULLED = ("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment "
                "FROM customer")


@register("P8_mode_impute", f"""
WITH c AS ({_CUST_NULLED}),
m AS (SELECT segment FROM c WHERE segment IS NOT NULL GROUP BY segment
      ORDER BY count(*) DESC, segment LIMIT 1)
SELECT c_custkey AS id, coalesce(c.segment, m.segment) AS segment FROM c, m""")
def p8_mode_impute(spark, sf):
    c = read_table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
        .alias("segment"))
    mode = P.fit_modes(c, ["segment"])["segment"]
    return c.select(F.col("c_custkey").alias("id"),
                    F.coalesce(F.col("segment"), F.lit(mode)).alias("segment"))


@register("P9_standardise", _with(PART_SQL) + f"SELECT id, {sql_r6('z')} AS z FROM pz")
def p9_standardise(spark, sf):
    tr, te = part_cases(spark, sf)
    both = tr.unionByName(te)
    return both.select("id", r6(F.col("x")[0]).alias("z"))


_CUST_SPLIT = f"""
c AS (SELECT c_custkey AS id, c_mktsegment AS seg, {bucket_sql('c_custkey')} % 100 AS bucket FROM customer),
cv AS (SELECT list(DISTINCT seg ORDER BY seg) AS v FROM c WHERE bucket < 80)"""


@register("P10_onehot", _with(_CUST_SPLIT) + """
SELECT id, CAST(pos AS INTEGER) AS pos, CASE WHEN v[pos + 1] = seg THEN 1.0 ELSE 0.0 END AS v
FROM (SELECT id, seg, cv.v, unnest(range(len(cv.v))) AS pos FROM c, cv)""")
def p10_onehot(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                                 F.col("c_mktsegment").alias("seg"))
    tr, _ = P.train_test_split(c, "id", 80, 2)
    _, vocab = P.fit_nominal_stats(tr, ["seg"])["seg"]
    from casediff.functions.arrays import onehot
    return c.select("id", F.posexplode(onehot("seg", vocab))).select("id", "pos", F.col("col").alias("v"))


@register("P11_label_encode", _with(_CUST_SPLIT) + """
SELECT id, CAST(list_position(cv.v, seg) - 1 AS INTEGER) AS code FROM c, cv""")
def p11_label_encode(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"),
                                                 F.col("c_mktsegment").alias("seg"))
    tr, _ = P.train_test_split(c, "id", 80, 2)
    return P.encode_by_table(c, "seg", P.value_codes(tr, "seg")).select("id", F.col("code").cast("int").alias("code"))


@register("P12_compose_features", _with(PART_SQL) + f"""
SELECT id, CAST(pos AS INTEGER) AS pos, {sql_r6('x[pos + 1]')} AS v
FROM (SELECT id, x, unnest(range(len(x))) AS pos FROM pz)""")
def p12_compose(spark, sf):
    tr, te = part_cases(spark, sf)
    both = tr.unionByName(te)
    return both.select("id", F.posexplode("x")).select("id", "pos", r6("col").alias("v"))


_EMB_LONG = """
SELECT vec_id AS id, CAST(pos AS INTEGER) AS pos, {expr} AS v
FROM (SELECT vec_id, embedding, label, unnest(range(len(embedding))) AS pos FROM embeddings)"""


@register("P13_densify", _EMB_LONG.format(expr=sql_r6("embedding[pos + 1]")))
def p13_densify(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    vec = emb.select(F.col("vec_id").alias("id"), array_to_vector("embedding").alias("vec"))
    arr = vec.select("id", P.densify("vec").alias("x"))
    return arr.select("id", F.posexplode("x")).select("id", "pos", r6("col").alias("v"))


_PIXEL = "least(255, greatest(0, CAST(round((embedding[pos + 1]::DOUBLE + 1.0) * 127.5) AS INTEGER)))"


@register("P14_pixel_scale", _EMB_LONG.format(expr=sql_r6(f"{_PIXEL} / 255.0")))
def p14_pixel_scale(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    img = emb.select(F.col("vec_id").alias("id"), pseudo_image("embedding").alias("px"))
    return img.select("id", F.posexplode(P.scale_pixels("px"))).select(
        "id", "pos", r6("col").alias("v"))


@register("P15_onehot_label", """
SELECT vec_id AS id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos = label THEN 1.0 ELSE 0.0 END AS v
FROM (SELECT vec_id, label, unnest(range(10)) AS pos FROM embeddings)""")
def p15_onehot_label(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return emb.select(F.col("vec_id").alias("id"), F.posexplode(P.onehot_label("label", 10))) \
        .select("id", "pos", F.col("col").alias("v"))


@register("P16_continuous_target", "SELECT vec_id AS id, CAST(label AS DOUBLE) AS y FROM embeddings")
def p16_continuous(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return emb.select(F.col("vec_id").alias("id"), P.as_continuous("label").alias("y"))
