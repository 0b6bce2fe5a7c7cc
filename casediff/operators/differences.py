"""Difference projections and reshaping.

They run on a neighbour table produced by :func:`casediff.operators.knn.knn_join`
with the query payload kept (``q_x``, ``q_y``) and the neighbour payload
carried (``n_x``, ``n_y``), so no extra join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casediff.functions.arrays import array_absdiff, array_sub, interleave


def pair_payload(x: str = "x", y: str | None = "y"):
    """``keep`` / ``carry`` arguments of ``knn_join`` for the difference ops."""
    keep = [("q_x", x)] + ([("q_y", y)] if y else [])
    carry = [("n_x", x)] + ([("n_y", y)] if y else [])
    return keep, carry


def feature_difference() -> Column:
    """``q_x - n_x`` (base or query minus neighbour)."""
    return array_sub("q_x", "n_x")


def target_difference() -> Column:
    """``q_y - n_y``."""
    return (F.col("q_y") - F.col("n_y")).cast("double")


def with_context(dx: Column) -> Column:
    """Interleave ``[d1, x1, d2, x2, ...]`` with the base/query case."""
    return interleave(dx, F.col("q_x"))


def with_distance(features: Column) -> Column:
    """Append the neighbour distance as the last feature."""
    return F.concat(features, F.array(F.col("dist")))


def adapter_features(context: bool = False, distance_column: bool = False) -> Column:
    """One layout for fit and predict: ``dx`` or ``interleave(dx, x)``, then ``[dist]``."""
    f = feature_difference()
    if context:
        f = with_context(f)
    if distance_column:
        f = with_distance(f)
    return f


def difference_table(pairs: DataFrame, *, context: bool = False,
                     distance_column: bool = False, with_target: bool = True) -> DataFrame:
    """D1/D2 (+D4, D7): ``query_id, neighbour_id, rank, dist, dx, features[, dy]``."""
    cols = [
        "query_id", "neighbour_id", "rank", "dist",
        feature_difference().alias("dx"),
        adapter_features(context, distance_column).alias("features"),
    ]
    if with_target:
        cols.append(target_difference().alias("dy"))
    extra = [c for c in ("n_y",) if c in pairs.columns]
    return pairs.select(*cols, *extra)


def duplication_bounds(diffs: DataFrame) -> tuple[float | None, float | None]:
    """Global min and max of ``ln(dist + 1)`` (two numbers)."""
    r = diffs.agg(F.min(F.log(F.col("dist") + 1.0)).alias("lo"),
                  F.max(F.log(F.col("dist") + 1.0)).alias("hi")).first()
    return r["lo"], r["hi"]


def duplication_weight(lo: float | None, hi: float | None) -> Column:
    """D6 count per row: ``round_half_even(10 - (l - lo) / (hi - lo) * 10)``, 1 if lo = hi."""
    if lo is None or hi is None or lo == hi:
        return F.lit(1)
    l = F.log(F.col("dist") + 1.0)
    return F.bround(F.lit(10.0) - (l - F.lit(lo)) / F.lit(hi - lo) * F.lit(10.0), 0).cast("int")


def with_duplication_weight(diffs: DataFrame) -> DataFrame:
    """D6 as a weight column (each row keeps its own count; X4)."""
    lo, hi = duplication_bounds(diffs)
    return diffs.withColumn("weight", duplication_weight(lo, hi))


def duplicate_by_distance(diffs: DataFrame) -> DataFrame:
    """D6 as row copies: rows with weight 0 are dropped, others repeated.

    The two bounds come from an aggregate of their own; nothing stays cached (a caller
    that reads ``diffs`` often keeps it, as ``training_differences`` does)."""
    w = with_duplication_weight(diffs)
    return w.where(F.col("weight") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("weight"))))


# -- implicit case pairs (D8, D9) ------------------------------------------


def case_pair() -> Column:
    """``[retrieved : base]`` -- source (neighbour) first, target second."""
    return F.concat(F.col("n_x"), F.col("q_x"))


# -- images (D10-D12) -------------------------------------------------------


def image_difference() -> Column:
    """Absolute pixel difference (computed on INT, no wrap)."""
    return array_absdiff(F.transform("q_x", lambda v: v.cast("int")),
                         F.transform("n_x", lambda v: v.cast("int")))


def mean_difference_image(pairs: DataFrame) -> DataFrame:
    """Per query, the mean absolute difference image over its neighbours.

    ``collect_list`` holds at most k images per query (bounded by k); the
    arrays are summed in rank order inside the JVM.
    """
    absdiff = pairs.select("query_id", "rank",
                           F.transform(array_absdiff("q_x", "n_x"),
                                       lambda v: v.cast("double")).alias("d"))
    g = absdiff.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "d"))).alias("imgs"))
    first = F.col("imgs")[0]["d"]
    total = F.aggregate(
        F.slice("imgs", 2, 1 << 30), first,
        lambda acc, e: F.zip_with(acc, e["d"], lambda a, b: a + b))
    return g.select("query_id", F.transform(total, lambda v: v / F.size("imgs")).alias("mean_diff"))
