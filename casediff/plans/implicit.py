"""Implicit learners (U3 LIC, U4 LIR): per-class adaptation of case pairs.

fit:      K3 1-NN self join -> D8 pair ``[retrieved : base]`` -> D9 grouped by
          the retrieved case's class -> one adapter per class (L3).
          The class pool of class c = the retrieved cases of class c,
          deduplicated by id (semi join).
predict:  K4 N nearest per class (K5: one; K6: N random, seeded) ->
          pair ``[pool case : query]`` -> that class's adapter (L5) ->
          vote over all classes (A5; ties -> first class, then nearest).

Modes and trees are fitted and scored for all classes at once; ``pyspark.ml``
learners in a driver loop over the classes (each ``fit`` is distributed).  Class skew does not concentrate work in one task because the
kNN join is blocked by a hash of the id, not by class.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casediff.operators import differences as D
from casediff.operators import vote as V
from casediff.operators.adapters import MLClassAdapter, TreeAdapter
from casediff.operators.knn import EUCLIDEAN, DistanceSpec, knn_join, stored
from casediff.operators.prep import MAX_VOCABULARY
from casediff.operators.sampling import random_cases


def case_pairs(cases: DataFrame, *, spec: DistanceSpec = EUCLIDEAN, strategy: str = "auto") -> DataFrame:
    """K3 + D8 + D9: ``(src_class, src_id, target_id, pair, label)``."""
    nb = knn_join(cases, cases, 1, exclude_self=True, spec=spec, strategy=strategy,
                  keep=[("q_x", "x"), ("q_y", "y")], carry=[("n_x", "x"), ("n_y", "y")])
    return nb.select(F.col("n_y").alias("src_class"), F.col("neighbour_id").alias("src_id"),
                     F.col("query_id").alias("target_id"), D.case_pair().alias("pair"),
                     F.col("q_y").alias("label"))


def class_pools(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """Retrieved cases with their class: ``(id, x, cls)`` (semi join, deduplicated)."""
    used = pairs.select(F.col("src_id").alias("id"))
    return cases.join(used, "id", "left_semi").select("id", "x", F.col("y").alias("cls"))


@dataclass
class ImplicitModel:
    pools: DataFrame
    classes: list
    adapters: dict = field(default_factory=dict)   # class -> MLClassAdapter
    modes: DataFrame | None = None                 # (cls, mode_label) for adapter="mode"
    trees: TreeAdapter | None = None               # one tree a class, for adapter="tree"
    n_neighbours: int = 5
    single_pair: bool = False
    random_pairs: bool = False
    seed: int = 0
    spec: DistanceSpec = EUCLIDEAN
    strategy: str = "auto"
    held: list = field(default_factory=list)       # persisted frames the model owns

    def release(self) -> None:
        """Unpersist what fitting and scoring kept; later calls compute it again."""
        while self.held:
            self.held.pop().unpersist()

    def candidates(self, queries: DataFrame) -> DataFrame:
        """K4 / K5 / K6 with the pair vector: ``(query_id, cls, neighbour_id, rank, dist, pair)``."""
        n = 1 if self.single_pair else self.n_neighbours
        if self.random_pairs:
            c = random_cases(queries, self.pools, n, "cls", seed=self.seed, keep=[("q_x", "x")],
                             carry=[("n_x", "x")]).withColumn("dist", F.lit(None).cast("double"))
        else:
            c = knn_join(queries, self.pools, n, by="cls", spec=self.spec, strategy=self.strategy,
                         keep=[("q_x", "x")], carry=[("n_x", "x")])
        return c.select("query_id", "cls", "neighbour_id", "rank", "dist",
                        D.case_pair().alias("pair"))

    def score(self, queries: DataFrame) -> DataFrame:
        """Every candidate pair scored by its class's adapter -> ``pred``."""
        return self.score_candidates(self.candidates(queries))

    def score_candidates(self, cand: DataFrame) -> DataFrame:
        """L5 on any ``(query_id, cls, ..., pair)`` table."""
        if self.modes is not None:
            return cand.join(self.modes, "cls").withColumnRenamed("mode_label", "pred")
        if self.trees is not None:
            return self.trees.score(cand, "pair").withColumnRenamed("dhat", "pred")
        # One filtered read per class: keep the candidates (recomputable on loss).
        cand = cand.persist(StorageLevel.MEMORY_AND_DISK)
        self.held.append(cand)
        parts = []
        for cls in self.classes:
            sub = cand.where(F.col("cls") == F.lit(cls))
            scored = self.adapters[cls].score(sub, "pair")
            parts.append(scored.withColumnRenamed("dhat", "pred"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def predict(self, queries: DataFrame, out: str = "prediction") -> DataFrame:
        """A5: majority vote; ties -> the first class (sorted), then the nearest."""
        scored = self.score(queries)
        order = scored.withColumn("rank", F.struct(F.col("cls"), F.col("rank")))
        return V.majority_vote(order, F.col("pred"), out)


def fit_implicit(cases: DataFrame, *, adapter: str | object = "mode", n_neighbours: int = 5,
                 single_pair: bool = False, random_pairs: bool = False, seed: int = 0,
                 spec: DistanceSpec = EUCLIDEAN, strategy: str = "auto",
                 hidden_layer_sizes=(100,), max_iter: int = 200,
                 parallel_fits: int = 4) -> ImplicitModel:
    """Fit the implicit classifier on ``(id, x, y)`` with y a class label.

    ``adapter``: ``"mode"`` (the class's most frequent target label) and ``"tree"`` or a
    ``TreeAdapter`` serve all classes in one job; a ``pyspark.ml`` learner or ``"mlp"`` is
    fitted per class from the driver."""
    # Read once per class and for the pools: keep it (recomputable on loss).
    pairs = case_pairs(cases, spec=spec, strategy=strategy).persist(StorageLevel.MEMORY_AND_DISK)
    if adapter in ("mode", "tree") or isinstance(adapter, TreeAdapter):
        model = ImplicitModel(pools=class_pools(cases, pairs), classes=[], n_neighbours=n_neighbours,
                              single_pair=single_pair, random_pairs=random_pairs, seed=seed,
                              spec=spec, strategy=strategy, held=[pairs])
        if adapter == "mode":
            counts = pairs.groupBy("src_class", "label").agg(F.count(F.lit(1)).alias("n"))
            model.modes = counts.groupBy(F.col("src_class").alias("cls")).agg(
                F.min_by("label", F.struct((-F.col("n")).alias("nn"), F.col("label").alias("l")))
                .alias("mode_label"))
            return model
        trees = adapter if isinstance(adapter, TreeAdapter) else TreeAdapter()
        model.trees = TreeAdapter(trees.depth, trees.bins, group="cls").fit(
            pairs.withColumnRenamed("src_class", "cls"), "pair", "label")
        return model
    n_cls = pairs.select("src_class").distinct().count()
    if n_cls > MAX_VOCABULARY:
        raise ValueError(f"{n_cls} classes; too many for per-class adapters")
    classes = sorted(r[0] for r in pairs.select("src_class").distinct().collect())
    pools = class_pools(cases, pairs)
    model = ImplicitModel(pools=pools, classes=classes, n_neighbours=n_neighbours,
                          single_pair=single_pair, random_pairs=random_pairs, seed=seed,
                          spec=spec, strategy=strategy, held=[pairs])
    est = adapter if not isinstance(adapter, str) else None

    def fit_one(cls):
        sub = pairs.where(F.col("src_class") == F.lit(cls)).select("pair", "label")
        a = MLClassAdapter(est, hidden_layer_sizes=hidden_layer_sizes, max_iter=max_iter)
        return cls, a.fit(sub, "pair", "label")

    # Each fit is a distributed job; a few run at once from driver threads.
    with ThreadPoolExecutor(max_workers=max(1, min(parallel_fits, len(classes)))) as pool:
        model.adapters = dict(pool.map(fit_one, classes))
    return model


# -- report-only variants (R0-R5), composed from the operators above ------------------


def predict_by_nearest_class(model: ImplicitModel, queries: DataFrame, n: int = 1,
                             out: str = "prediction") -> DataFrame:
    """R3 (``n=1``): the nearest retrieved case picks the class adapter; R4 (``n>1``):
    the n nearest retrieved cases each use their class's adapter, then a vote (A3)."""
    c = knn_join(queries, model.pools, n, spec=model.spec, strategy=model.strategy,
                 keep=[("q_x", "x")], carry=[("n_x", "x"), "cls"])
    cand = c.select("query_id", "cls", "neighbour_id", "rank", "dist",
                    D.case_pair().alias("pair"))
    scored = model.score_candidates(cand)
    return V.majority_vote(scored, F.col("pred"), out)


def predict_nearest_pair(cases: DataFrame, queries: DataFrame, *,
                         spec: DistanceSpec = EUCLIDEAN, strategy: str = "auto",
                         out: str = "prediction") -> DataFrame:
    """R0 (no learned model): the query's nearest case fixes a class; among the case
    pairs of that class, the pair nearest to ``[nearest case : query]`` gives the label."""
    pairs = case_pairs(cases, spec=spec, strategy=strategy)
    pair_cases = pairs.select(F.col("target_id").alias("id"), F.col("pair").alias("x"),
                              F.col("src_class").alias("grp"), "label")
    nn = knn_join(queries, cases, 1, spec=spec, strategy=strategy,
                  keep=[("q_x", "x")], carry=[("n_x", "x"), ("n_y", "y")])
    qpairs = nn.select(F.col("query_id").alias("id"), D.case_pair().alias("x"),
                       F.col("n_y").alias("grp"))
    # Both sides are neighbour joins of their own, and a join reads its input several times: written once.
    qpairs, pair_cases = stored(qpairs, "query-pairs").drop("_row"), stored(pair_cases, "case-pairs").drop("_row")
    best = knn_join(qpairs, pair_cases, 1, strategy=strategy, match_group="grp",
                    carry=["label"])
    return best.select("query_id", F.col("label").alias(out))


def fit_pair_classifier(cases: DataFrame, *, with_class: bool = False, adapter=None,
                        strategy: str = "auto"):
    """R1 (``[neighbour : base] -> base label``) / R2 (plus the neighbour's class)."""
    pairs = case_pairs(cases, strategy=strategy).persist(StorageLevel.MEMORY_AND_DISK)
    feats = F.concat("pair", F.array(F.col("src_class").cast("double"))) if with_class \
        else F.col("pair")
    a = adapter or MLClassAdapter(hidden_layer_sizes=(16,), max_iter=50)
    try:
        return a.fit(pairs.select(feats.alias("features"), "label"), "features", "label")
    finally:
        pairs.unpersist()


def predict_pair_classifier(adapter, cases: DataFrame, queries: DataFrame, k: int = 5, *,
                            with_class: bool = False, strategy: str = "auto",
                            out: str = "prediction") -> DataFrame:
    nb = knn_join(queries, cases, k, strategy=strategy, keep=[("q_x", "x")],
                  carry=[("n_x", "x"), ("n_y", "y")])
    feats = D.case_pair()
    if with_class:
        feats = F.concat(feats, F.array(F.col("n_y").cast("double")))
    scored = adapter.score(nb.select("query_id", "rank", "dist", feats.alias("features")),
                           "features")
    return V.majority_vote(scored, F.col("dhat"), out)
