"""Case tables built from the driver's tables, and the matching oracle SQL.

Every registered query starts from one of these.  The split, scaling and
encoding are fitted in Spark on the whole table; the SQL snippets compute the
same thing in DuckDB so the two can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casediff.functions.arrays import as_double_array
from casediff.operators.prep import (
    _A,
    _M,
    _SEED_STEP,
    _SHIFTS,
    fit_preparation,
    seeded_hash,
    train_test_split,
)
from casediff.schema import CaseSchema
from casediff.sources.tables import read_table

SEED = 2
TRAIN_PERCENT = 80
K = 5

PART_SCHEMA = CaseSchema(id="p_partkey", target="p_retailprice", numeric=("p_size",),
                         nominal=("p_type",))


def r6(col):
    """Published doubles: 6 places, and never a negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def sql_r6(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0)"


# Scores averaged over cent-valued errors can be exact decimals ending in 5 at
# the 7th place, where 6-place rounding depends on the summation order; they
# are published with 5 places.
def r5(col):
    return F.round(col, 5) + F.lit(0.0)


def sql_r5(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 5) + 0.0)"


def ols_sql(y: str, x: str) -> str:
    """``s, i`` of least squares of y on x; a constant x gives ``0, avg(y)``."""
    return (f"CASE WHEN var_pop({x}) > 0 THEN regr_slope({y}, {x}) ELSE 0.0 END AS s, "
            f"CASE WHEN var_pop({x}) > 0 THEN regr_intercept({y}, {x}) ELSE avg({y}) END AS i")


def bucket_sql(id_col: str, seed: int = SEED) -> str:
    """The SQL form of :func:`casediff.operators.prep.seeded_hash`."""
    x = f"(({id_col}::BIGINT + {seed * _SEED_STEP}) % {_M})"
    for shift in _SHIFTS:
        x = f"(list_transform([({x} * {_A}) % {_M}], lambda h: xor(h, h >> {shift}))[1])"
    return f"({x} % {_M})"


# -- part: mixed-type regression ------------------------------------------


def part_cases(spark: SparkSession, sf_dir: str, *, with_codes: bool = False,
               with_raw: bool = False):
    """``(train, test)`` case tables of ``part``: x = [z(p_size), onehot(p_type)], y = price."""
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_type", "p_retailprice")
    train, test = train_test_split(part, "p_partkey", TRAIN_PERCENT, SEED)
    prep = fit_preparation(train, PART_SCHEMA)
    tr = prep.transform(train, with_codes=with_codes)
    te = prep.transform(test, with_codes=with_codes)
    if with_raw:
        tr = tr.join(train.select(F.col("p_partkey").alias("id"), "p_size", "p_type"), "id")
        te = te.join(test.select(F.col("p_partkey").alias("id"), "p_size", "p_type"), "id")
    return tr, te


PART_SQL = f"""
p AS (SELECT p_partkey AS id, p_size, p_type, p_retailprice AS y,
             {bucket_sql('p_partkey')} % 100 AS bucket FROM part),
st AS (SELECT avg(p_size)::DOUBLE AS mu,
              CASE WHEN stddev_pop(p_size) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(p_size)::DOUBLE END AS sd
       FROM p WHERE bucket < {TRAIN_PERCENT}),
voc AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS v FROM p WHERE bucket < {TRAIN_PERCENT}),
pz AS (SELECT id, bucket, (p_size - mu) / sd AS z, p_type, y,
              list_concat([(p_size - mu) / sd],
                          list_transform(voc.v, lambda t: CASE WHEN t = p_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS x
       FROM p, st, voc),
tr AS (SELECT id, z, p_type, y, x FROM pz WHERE bucket < {TRAIN_PERCENT}),
te AS (SELECT id, z, p_type, y, x FROM pz WHERE bucket >= {TRAIN_PERCENT})
"""

PART_D2 = "(a.z - b.z) * (a.z - b.z) + CASE WHEN a.p_type = b.p_type THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END"


# -- embeddings: numeric classification -------------------------------------


def embedding_cases(spark: SparkSession, sf_dir: str):
    """``(train, test)`` of ``embeddings``: x = embedding as doubles, y = label."""
    emb = read_table(spark, sf_dir, "embeddings")
    cases = emb.select(F.col("vec_id").alias("id"), as_double_array("embedding").alias("x"),
                       F.col("label").alias("y"))
    return train_test_split(cases, "id", TRAIN_PERCENT, SEED)


EMB_SQL = f"""
e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label AS y,
             {bucket_sql('vec_id')} % 100 AS bucket FROM embeddings),
etr AS (SELECT id, x, y FROM e WHERE bucket < {TRAIN_PERCENT}),
ete AS (SELECT id, x, y FROM e WHERE bucket >= {TRAIN_PERCENT})
"""

EMB_D2 = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def rank_key_sql(d2: str) -> str:
    """A squared distance to 12 significant digits: engines that add up in another order agree on ties."""
    return f"(CASE WHEN ({d2}) > 0 THEN round(({d2}) / pow(10.0, floor(log10({d2})) - 11)) * pow(10.0, floor(log10({d2})) - 11) ELSE 0.0 END)"


def knn_sql(name: str, q: str, c: str, d2: str, k: int, self_join: bool,
            extra_pred: str = "", partition: str = "") -> str:
    """CTE ``name(query_id, neighbour_id, rank, d2[, partition])``: top-k by (d2 to 12 digits, id)."""
    on = "a.id <> b.id" if self_join else "TRUE"
    if extra_pred:
        on = f"{on} AND {extra_pred}"
    part_sel = f", b.{partition} AS {partition}" if partition else ""
    part_by = f", {partition}" if partition else ""
    return f"""
{name}_all AS (SELECT a.id AS query_id, b.id AS neighbour_id, ({d2}) AS d2{part_sel}
               FROM {q} a JOIN {c} b ON {on}),
{name} AS (SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id{part_by}
                                      ORDER BY {rank_key_sql('d2')}, neighbour_id) AS INTEGER) AS rank
    FROM {name}_all) WHERE rank <= {k})
"""


__all__ = ["part_cases", "embedding_cases", "PART_SQL", "EMB_SQL", "PART_D2", "EMB_D2",
           "knn_sql", "r6", "sql_r6", "bucket_sql", "rank_key_sql", "seeded_hash", "K", "SEED"]
