"""Per-query aggregation of neighbour answers.

Every vote is one ``groupBy(query_id)``: the k candidate rows of a query are
few (bounded by k), so they are gathered with ``collect_list`` and resolved with
JVM higher-order functions -- no second shuffle for the tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def _weight() -> Column:
    return F.lit(1.0) / (F.col("dist") + F.lit(EPS))


def mean_value(pairs: DataFrame, value: Column, out: str = "prediction") -> DataFrame:
    """Plain mean of the value per query."""
    return pairs.groupBy("query_id").agg(F.avg(value).alias(out))


def inverse_distance_mean(pairs: DataFrame, value: Column, out: str = "prediction") -> DataFrame:
    """A2: ``sum(w * v) / sum(w)`` with ``w = 1 / (dist + 1e-8)``."""
    w = _weight()
    return pairs.groupBy("query_id").agg((F.sum(w * value) / F.sum(w)).alias(out))


def distance_weighted_mean(pairs: DataFrame, value: Column, out: str = "prediction") -> DataFrame:
    """B2: ``sum(v / d) / sum(1 / d)``; neighbours at distance 0 take over."""
    zero = F.col("dist") == 0.0
    n_zero = F.sum(zero.cast("int"))
    d = F.col("dist")
    return pairs.groupBy("query_id").agg(
        F.when(n_zero > 0, F.avg(F.when(zero, value)))
         .otherwise(F.sum(F.when(~zero, value / d)) / F.sum(F.when(~zero, F.lit(1.0) / d)))
         .alias(out))


def _resolve(pairs: DataFrame, value: Column, score: str, tie: str, out: str) -> DataFrame:
    """Group candidates per query, score each distinct vote, pick the best.

    ``score``: ``count`` | ``inv`` (sum of 1/(d+eps)) | ``knn`` (sum of 1/d,
    exact matches take over).  ``tie``: ``rank`` (nearest wins) or ``label``
    (smallest label wins).
    """
    g = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct(F.col("rank").alias("r"), value.alias("v"),
                 F.col("dist").alias("d")))).alias("c"))
    c = F.col("c")
    any_zero = F.exists(c, lambda e: e["d"] == 0.0)

    def weight(e):
        if score == "count":
            return F.lit(1.0)
        if score == "inv":
            return F.lit(1.0) / (e["d"] + F.lit(EPS))
        return F.when(any_zero, F.when(e["d"] == 0.0, 1.0).otherwise(0.0)) \
                .otherwise(F.lit(1.0) / e["d"])

    def total(e):
        same = F.filter(c, lambda o: o["v"] == e["v"])
        s = F.aggregate(same, F.lit(0.0), lambda acc, o: acc + weight(o))
        return s

    scored = F.transform(c, lambda e: F.struct(total(e).alias("s"), e["r"].alias("r"),
                                               e["v"].alias("v")))

    if score != "count":  # to 9 digits of the largest total, so that units do not matter and equal votes tie
        most = F.array_max(F.transform(scored, lambda e: e["s"]))
        scored = F.transform(scored, lambda e: F.struct(
            F.round(e["s"] / most, 9).alias("s"), e["r"].alias("r"), e["v"].alias("v")))

    def cmp(a, b):
        by_tie = (F.when(a["r"] < b["r"], -1).when(a["r"] > b["r"], 1).otherwise(0)
                  if tie == "rank" else
                  F.when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0))
        return F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).otherwise(by_tie)

    best = F.array_sort(scored, cmp)[0]
    return g.select("query_id", best["v"].alias(out))


def majority_vote(pairs: DataFrame, value: Column, out: str = "prediction") -> DataFrame:
    """Most common value; a tie goes to the nearest neighbour's value."""
    return _resolve(pairs, value, "count", "rank", out)


def inverse_distance_vote(pairs: DataFrame, value: Column, out: str = "prediction") -> DataFrame:
    """A4: value with the largest ``sum(1/(d+1e-8))``; ties -> nearest."""
    return _resolve(pairs, value, "inv", "rank", out)


def knn_vote(pairs: DataFrame, value: Column, out: str = "prediction") -> DataFrame:
    """Uniform kNN vote; a tie goes to the smallest label."""
    return _resolve(pairs, value, "count", "label", out)


def knn_weighted_vote(pairs: DataFrame, value: Column, out: str = "prediction") -> DataFrame:
    """``1/d`` weighted vote, exact matches take over; ties -> smallest label."""
    return _resolve(pairs, value, "knn", "label", out)


def round_label(col: str | Column) -> Column:
    """Round to the nearest integer label (half to even, as NumPy)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.bround(c, 0).cast("int")


def distinct_classes(df: DataFrame, label: str) -> DataFrame:
    """Distinct class labels."""
    return df.select(label).distinct()


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """A10: rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
