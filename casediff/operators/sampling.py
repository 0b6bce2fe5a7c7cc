"""Positions within groups, and what is drawn by position: random cases per class (K6), stratified folds."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casediff.operators.prep import seeded_hash

#: Ranges of the seeded hash in which the rows of a group are numbered, each by itself.
RANGE_BITS = 10
HASH_BITS = 31


def number_within(df: DataFrame, by: str, id_col: str = "id", seed: int = 0, out: str = "pos") -> DataFrame:
    """``out``: 0-based position of each row among the rows of its ``by`` value (null is a value), in the order of the
    seeded hash of the id, then the id; ``n_<out>``: the number of rows of that value.

    A group is numbered range by range of the hash, with the counts of the ranges before added, so a group that
    holds most rows is spread over ``2 ** RANGE_BITS`` tasks."""
    key = F.col(f"`{by}`")
    h = seeded_hash(id_col, seed)
    placed = df.withColumn("_h", h).withColumn("_range", F.shiftright("_h", HASH_BITS - RANGE_BITS).cast("int"))
    counts = placed.groupBy(key.alias("_by"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    ranges = Window.partitionBy("_by")
    counts = counts.select("_by", "_r", (F.sum("_n").over(ranges.orderBy("_r")) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(ranges).alias("_all"))
    j = placed.join(counts, key.eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r")))
    inside = Window.partitionBy("_by", "_r").orderBy("_h", id_col)
    return j.withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).withColumn(f"n_{out}", F.col("_all")).drop(
        "_h", "_range", "_by", "_r", "_before", "_all")


def stratified_folds(cases: DataFrame, label: str, n_folds: int = 10, seed: int = 0, id_col: str = "id") -> DataFrame:
    """A ``fold`` column; the rows of each label are dealt round-robin, so folds differ by one row a label."""
    numbered = number_within(cases, label, id_col, seed, "_pos")
    return numbered.withColumn("fold", F.pmod(F.col("_pos"), F.lit(n_folds)).cast("int")).drop("_pos", "n__pos")


def random_cases(queries: DataFrame, cases: DataFrame, n: int, by: str, *, seed: int = 0,
                 carry: Sequence[tuple[str, str]] = (), keep: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """K6: ``query_id, neighbour_id, by, rank, carried...``: ``n`` random cases of every class for every query.

    The cases of a class stand in a seeded random order, and a query takes ``n`` of them in turn from a place that
    its own seeded hash names.  So each query looks at the cases it draws and no others: one equi-join of ``n`` rows a
    class and query.  A class of fewer cases gives all of them."""
    key = F.col(f"`{by}`")
    numbered = number_within(cases, by, "id", seed, "_pos")
    # one row with all classes, as many as every query's answer has parts
    classes = numbered.groupBy(key.alias("cls")).agg(F.max("n__pos").alias("size"))
    classes = classes.agg(F.collect_list(F.struct("cls", "size")).alias("_classes")).withColumn("_one", F.lit(1))
    q = queries.select(F.col("id").alias("query_id"), F.lit(1).alias("_one"), seeded_hash("id", seed).alias("_h"),
                       *[F.col(src).alias(name) for name, src in keep])
    q = q.join(classes, "_one").withColumn("_c", F.explode("_classes"))
    q = q.withColumn("rank", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(n), F.col("_c.size")))))
    q = q.select("query_id", *[name for name, _ in keep], F.col("_c.cls").alias("_cls"), F.col("rank").cast("int").alias("rank"),
                 F.pmod(F.col("_h") + F.col("rank") - 1, F.col("_c.size")).alias("_at"))
    c = numbered.select(F.col("id").alias("neighbour_id"), key.alias(by), F.col("_pos"),
                        *[F.col(src).alias(name) for name, src in carry])
    return q.join(c, F.col("_cls").eqNullSafe(key) & (F.col("_at") == F.col("_pos"))).drop("_cls", "_at", "_pos")
