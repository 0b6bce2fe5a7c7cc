"""Neighbour corrections: from pair table to adapter to prediction, as DataFrame steps.

Case tables have ``id BIGINT, x ARRAY<DOUBLE>, y`` (and ``codes ARRAY<INT>``
for mixed metrics).

fit:      K1 self kNN -> D1/D2 (+ V1 context D4, V2 weight D6, V3 distance D7)
          -> adapter fit (L1/L2)
predict:  K2 kNN -> D3 (+ D5, D7) -> adapter score (L4) -> A1-A4 per query
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casediff.operators import differences as D
from casediff.operators import vote as V
from casediff.operators.adapters import Adapter
from casediff.operators.knn import EUCLIDEAN, DistanceSpec, broadcast_cases, knn_join


@dataclass
class Variant:
    """V1 ``context``, V2 ``duplicate``, V3 ``distance_column`` (any combination)."""

    context: bool = False
    duplicate: bool = False
    distance_column: bool = False


def neighbour_pairs(queries: DataFrame, cases: DataFrame, k: int, *, self_join: bool,
                    spec: DistanceSpec = EUCLIDEAN, strategy: str = "auto",
                    with_query_y: bool = True, **kw) -> DataFrame:
    """K1 / K2 with the payload the difference ops need (``q_x, q_y, n_x, n_y``)."""
    keep = [("q_x", "x")] + ([("q_y", "y")] if with_query_y and "y" in queries.columns else [])
    carry = [("n_x", "x"), ("n_y", "y")]
    return knn_join(queries, cases, k, exclude_self=self_join, spec=spec, carry=carry,
                    keep=keep, strategy=strategy, **kw)


def training_differences(cases: DataFrame, k: int, variant: Variant = Variant(), *,
                         spec: DistanceSpec = EUCLIDEAN, strategy: str = "auto",
                         cached: list | None = None, case_base=None) -> DataFrame:
    """Fit side: ``query_id, neighbour_id, rank, dist, dx, features, dy[, weight]``.

    Frames persisted on the way are appended to ``cached`` so the caller can
    release them once the adapter is fitted.
    """
    # ``case_base``: the same cases already broadcast (see ``broadcast_cases``).
    pairs = neighbour_pairs(cases, case_base if case_base is not None else cases, k,
                            self_join=True, spec=spec, strategy=strategy)
    diffs = D.difference_table(pairs, context=variant.context,
                               distance_column=variant.distance_column)
    if variant.duplicate:
        # Read twice (global bounds, then the weighted rows): keep it, it can
        # be recomputed from its lineage if an executor is lost.
        diffs = diffs.persist(StorageLevel.MEMORY_AND_DISK)
        if cached is not None:
            cached.append(diffs)
        diffs = D.with_duplication_weight(diffs).where(F.col("weight") > 0)
    return diffs


def fit_on_differences(cases: DataFrame, k: int, adapter: Adapter, variant: Variant = Variant(),
                       *, spec: DistanceSpec = EUCLIDEAN, strategy: str = "auto",
                       case_base=None) -> Adapter:
    """K1 -> differences -> adapter fit; intermediate caches are released after."""
    cached: list = []
    try:
        diffs = training_differences(cases, k, variant, spec=spec, strategy=strategy,
                                     cached=cached, case_base=case_base)
        return fit_adapter(diffs, adapter, variant)
    finally:
        for df in cached:
            df.unpersist()


def fit_adapter(diffs: DataFrame, adapter: Adapter, variant: Variant = Variant()) -> Adapter:
    return adapter.fit(diffs, "features", "dy", weight="weight" if variant.duplicate else None)


def scored_query_pairs(queries: DataFrame, cases: DataFrame, k: int, adapter: Adapter,
                       variant: Variant = Variant(), *, spec: DistanceSpec = EUCLIDEAN,
                       strategy: str = "auto") -> DataFrame:
    """Predict side up to L4: one row per (query, neighbour) with ``n_y`` and ``dhat``."""
    pairs = neighbour_pairs(queries, cases, k, self_join=False, spec=spec, strategy=strategy,
                            with_query_y=False)
    feats = pairs.select("query_id", "neighbour_id", "rank", "dist", "n_y",
                         D.adapter_features(variant.context, variant.distance_column)
                         .alias("features"))
    return adapter.score(feats, "features")


def aggregate(scored: DataFrame, task: str, weighted: bool, out: str = "prediction") -> DataFrame:
    """A1/A2 (regression) or A3/A4 (classification) on ``n_y + dhat``."""
    value = F.col("n_y").cast("double") + F.col("dhat")
    if task == "regression":
        return (V.inverse_distance_mean if weighted else V.mean_value)(scored, value, out)
    return (V.inverse_distance_vote if weighted else V.majority_vote)(scored, value, out)


def fit_predict(train: DataFrame, test: DataFrame, *, task: str, adapter: Adapter,
                k_fit: int = 5, k_predict: int = 5, weighted: bool | None = None,
                variant: Variant = Variant(), spec: DistanceSpec = EUCLIDEAN,
                strategy: str = "auto") -> DataFrame:
    """End to end: ``(query_id, prediction)`` for every test case."""
    if weighted is None:
        weighted = task == "regression"
    case_base = None
    if strategy in ("auto", "broadcast"):
        try:
            # Ship the case base once for the self join and the query join.
            case_base = broadcast_cases(train, carry=[("n_x", "x"), ("n_y", "y")], k=max(k_fit, k_predict))
        except ValueError:
            if strategy == "broadcast":
                raise
    fitted = fit_on_differences(train, k_fit, adapter, variant, spec=spec, strategy=strategy,
                                case_base=case_base)
    scored = scored_query_pairs(test, case_base if case_base is not None else train, k_predict,
                                fitted, variant, spec=spec, strategy=strategy)
    return aggregate(scored, task, weighted)


def clamp_to_known(predictions: DataFrame, labels: DataFrame, out: str = "prediction") -> DataFrame:
    """Predictions outside the known labels ``y`` become the nearest of them (ties: the smaller).

    The labels are sorted once and looked up from both sides; only distinct predictions meet them."""
    known = labels.select(F.col("y").cast("double").alias("v")).distinct().withColumn("known", F.col("v"))
    asked = predictions.select(F.col(out).cast("double").alias("v")).distinct()
    both = asked.withColumn("known", F.lit(None).cast("double")).unionByName(known)
    # distinct labels and predictions only: as many rows as there are classes and sums of class differences
    order = Window.orderBy("v")
    below = F.last("known", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("known", ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = both.select("v", "known", below.alias("lo"), above.alias("hi")).where(F.col("known").isNull()).select(
        F.col("v").alias("_v"), F.when(F.col("lo").isNull() | (F.col("hi") - F.col("v") < F.col("v") - F.col("lo")), F.col("hi"))
        .otherwise(F.col("lo")).alias("_near"))
    return predictions.join(near, F.col(out).cast("double") == F.col("_v"), "left").withColumn(out, F.col("_near")).drop("_v", "_near")


# -- kNN baselines (B1-B4) -------------------------------------------------


def knn_baseline(train: DataFrame, test: DataFrame, k: int, *, task: str, weighted: bool,
                 spec: DistanceSpec = EUCLIDEAN, strategy: str = "auto",
                 out: str = "prediction") -> DataFrame:
    pairs = knn_join(test, train, k, spec=spec, carry=[("n_y", "y")], strategy=strategy)
    if task == "regression":
        value = F.col("n_y").cast("double")
        return (V.distance_weighted_mean if weighted else V.mean_value)(pairs, value, out)
    return (V.knn_weighted_vote if weighted else V.knn_vote)(pairs, F.col("n_y"), out)
