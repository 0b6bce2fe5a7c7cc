"""Scores, cross-validation and tuning.

Cross-validation of the kNN-based learners needs no per-fold join: one kNN
join with ``exclude_group="fold"`` returns, for every case, its neighbours from
the *other* folds, at the largest k of the grid; each k of the grid is a
``rank <= k`` filter on that one table (E1, E2).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casediff.operators import vote as V
from casediff.operators.knn import EUCLIDEAN, DistanceSpec, knn_join
from casediff.operators.prep import fold_of
from casediff.operators.sampling import stratified_folds


def accuracy(df: DataFrame, pred: str, label: str) -> DataFrame:
    """E5."""
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def neg_mae(df: DataFrame, pred: str, label: str) -> DataFrame:
    """The regression score (negative mean absolute error)."""
    return df.agg((-F.avg(F.abs(F.col(pred) - F.col(label)))).alias("neg_mae"))


def mse(df: DataFrame, pred: str, label: str) -> DataFrame:
    """E7."""
    d = F.col(pred) - F.col(label)
    return df.agg(F.avg(d * d).alias("mse"))


def target_variance(df: DataFrame, label: str) -> DataFrame:
    """Population variance of the target."""
    return df.agg(F.var_pop(F.col(label)).alias("var_y"))


def with_folds(cases: DataFrame, n_folds: int = 10, seed: int = 0, stratify: str | None = None) -> DataFrame:
    """Fold column from the seeded hash of the id; with ``stratify``, the rows of each value of that column are
    dealt evenly over the folds."""
    if stratify is not None:
        return stratified_folds(cases, stratify, n_folds, seed)
    return cases.withColumn("fold", fold_of("id", n_folds, seed))


def cv_knn_scores(cases: DataFrame, ks: Sequence[int], *, task: str, weighted: bool,
                  n_folds: int = 10, seed: int = 0, spec: DistanceSpec = EUCLIDEAN,
                  strategy: str = "auto", stratify: str | None = None) -> DataFrame:
    """E1 + E2 for the kNN baselines: ``(k, score)`` with the fold-mean score.

    Score is ``neg_mae`` for regression and ``accuracy`` for classification.
    """
    folded = with_folds(cases, n_folds, seed, stratify)
    k_max = max(ks)
    pairs = knn_join(folded, folded, k_max, exclude_self=True, spec=spec,
                     carry=[("n_y", "y")], keep=[("q_y", "y"), ("q_fold", "fold")],
                     exclude_group="fold", strategy=strategy)
    # Each neighbour row serves every k of the grid it is within (no join).
    grid = F.array(*[F.lit(int(k)) for k in sorted(set(ks))])
    per_k = pairs.withColumn("k", F.explode(F.filter(grid, lambda g: g >= F.col("rank"))))
    # the query's own columns ride in the key, so the truth needs no second pass over the join
    per_k = per_k.withColumn("query_key", F.struct("k", "query_id", "q_y", "q_fold"))
    value = F.col("n_y").cast("double") if task == "regression" else F.col("n_y")
    keyed = per_k.select(F.col("query_key").alias("query_id"), "rank", "dist", "n_y")
    if task == "regression":
        agg = (V.distance_weighted_mean if weighted else V.mean_value)(keyed, value)
    else:
        agg = (V.knn_weighted_vote if weighted else V.knn_vote)(keyed, value)
    j = agg.select("query_id.k", "query_id.q_fold", "prediction", "query_id.q_y")
    if task == "regression":
        score = -F.avg(F.abs(F.col("prediction") - F.col("q_y")))
    else:
        score = F.avg((F.col("prediction") == F.col("q_y")).cast("double"))
    per_fold = j.groupBy("k", "q_fold").agg(score.alias("s"))
    return per_fold.groupBy("k").agg(F.avg("s").alias("score"))


def best_k(scores: DataFrame) -> int:
    """The k with the highest CV score (smallest k on ties)."""
    r = scores.orderBy(F.col("score").desc(), F.col("k")).first()
    return int(r["k"])


# -- tuning of the learner (E2, E3, second stage) ---------------------------------------

#: The flags of the learner and the feature that its one-feature adapter reads: the difference
#: itself, the case in the interleaved layout (V1), the appended distance (V3).
FLAGS = {"plain": "dx", "context": "x", "distance": "dist"}


def cv_learner_scores(cases: DataFrame, k_fit: Sequence[int], k_predict: Sequence[int], *, index: int = 0,
                      n_folds: int = 10, seed: int = 0, spec: DistanceSpec = EUCLIDEAN,
                      strategy: str = "auto") -> DataFrame:
    """Second stage of E3: ``k_fit, k_predict, flag, weighted, score`` (mean over the folds of -MAE) of the
    difference regressor with least squares on one feature (``index`` of the vector).

    One join finds every case's nearest cases in each fold, at the largest k; without fold ``v`` its
    neighbours are the first of the other folds' lists.  So no join is repeated for a fold.  The
    adapters of all folds and settings come from one aggregate of additive sums per (fold left out,
    rank): those of ``kFit`` are the sums over the ranks up to it."""
    k_max = max(*k_fit, *k_predict)
    at = index + 1 if index >= 0 else index
    flat = with_folds(cases, n_folds, seed).withColumn("v", F.element_at("x", at))
    near = knn_join(flat, flat, k_max, exclude_self=True, spec=spec, by="fold", strategy=strategy,
                    carry=[("n_y", "y"), ("n_v", "v")], keep=[("q_y", "y"), ("q_v", "v"), ("q_fold", "fold")])
    neighbour = F.struct("d2r", "neighbour_id", "fold", "dist", "n_y", "n_v")
    lists = near.groupBy("query_id", "q_y", "q_v", "q_fold").agg(F.sort_array(F.collect_list(neighbour)).alias("all"))
    # without fold v: at most k_max of n_folds * k_max neighbours
    out = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("left_out")
    lists = lists.select("query_id", "q_y", "q_v", "q_fold", "all", out)
    first = F.slice(F.filter("all", lambda n: n["fold"] != F.col("left_out")), 1, k_max)
    pairs = lists.select("query_id", "q_y", "q_v", "q_fold", "left_out", F.posexplode(first).alias("pos", "n"))
    pairs = pairs.select("query_id", "q_y", "q_fold", "left_out", (F.col("pos") + 1).alias("rank"), F.col("n.dist").alias("dist"),
                         F.col("n.n_y").alias("n_y"), (F.col("q_v") - F.col("n.n_v")).alias("dx"), F.col("q_v").alias("x"))
    flags = F.explode(F.array(*[F.struct(F.lit(name).alias("flag"), F.col(col).cast("double").alias("f"))
                                for name, col in FLAGS.items()])).alias("s")
    dy = F.col("q_y") - F.col("n_y")
    train = pairs.where(F.col("q_fold") != F.col("left_out")).select("left_out", "rank", dy.alias("dy"), flags).select(
        "left_out", "rank", "dy", "s.flag", "s.f")
    sums = train.groupBy("left_out", "flag", "rank").agg(
        F.count(F.lit(1)).alias("n"), F.sum("f").alias("sx"), F.sum("dy").alias("sy"),
        F.sum(F.col("f") * F.col("f")).alias("sxx"), F.sum(F.col("f") * F.col("dy")).alias("sxy"))
    ks = F.array(*[F.lit(int(k)) for k in sorted(set(k_fit))])
    sums = sums.withColumn("k_fit", F.explode(F.filter(ks, lambda k: k >= F.col("rank"))))
    sums = sums.groupBy("left_out", "flag", "k_fit").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    # a feature whose variance is rounding error counts as constant
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(den > 1e-9 * F.col("n") * F.col("sxx"), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / den).otherwise(0.0)
    fits = sums.withColumn("slope", slope).select(
        "left_out", "flag", "k_fit", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))
    # all adapters: folds x flags x kFit rows, a number of settings
    check = pairs.where(F.col("q_fold") == F.col("left_out")).select(
        "query_id", "q_y", "left_out", "rank", "dist", "n_y", flags).select(
        "query_id", "q_y", "left_out", "rank", "dist", "n_y", "s.flag", "s.f")
    scored = check.join(F.broadcast(fits), ["left_out", "flag"])
    value = F.col("n_y") + F.col("slope") * F.col("f") + F.col("intercept")
    kp = F.array(*[F.lit(int(k)) for k in sorted(set(k_predict))])
    scored = scored.withColumn("value", value).withColumn("k_predict", F.explode(F.filter(kp, lambda k: k >= F.col("rank"))))
    w = 1.0 / (F.col("dist") + 1e-8)
    pred = scored.groupBy("left_out", "query_id", "q_y", "k_fit", "k_predict", "flag").agg(
        F.avg("value").alias("plain_mean"), (F.sum(w * F.col("value")) / F.sum(w)).alias("weighted_mean"))
    both = F.explode(F.array(F.struct(F.lit(False).alias("weighted"), F.col("plain_mean").alias("p")),
                             F.struct(F.lit(True).alias("weighted"), F.col("weighted_mean").alias("p")))).alias("m")
    pred = pred.select("left_out", "q_y", "k_fit", "k_predict", "flag", both)
    per_fold = pred.groupBy("left_out", "k_fit", "k_predict", "flag", "m.weighted").agg(
        (-F.avg(F.abs(F.col("m.p") - F.col("q_y")))).alias("s"))
    return per_fold.groupBy("k_fit", "k_predict", "flag", "weighted").agg(F.avg("s").alias("score"))
