"""Adapters: models trained on the difference table.

An adapter maps the difference features of a (case, neighbour) pair to a
predicted target difference ``dhat``.  ``fit`` runs distributed; ``score``
adds a ``dhat`` column to a difference table.

* ``ZeroAdapter``     -- ``dhat = 0`` (the learner reduces to kNN).
* ``OlsAdapter``      -- least squares on one difference feature, fitted with
  the SQL aggregates ``regr_slope`` / ``regr_intercept``.
* ``LinearAdapter``   -- ridge least squares on all features, from one Gram matrix.
* ``TreeAdapter``     -- decision trees for all source classes at once (L2, L3).
* ``ModeAdapter``     -- most frequent target difference (classification).
* ``MLAdapter``       -- any ``pyspark.ml`` regressor (L1).
* ``MLClassAdapter``  -- any ``pyspark.ml`` classifier on the difference
  treated as a nominal label (L2); the label is indexed first.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casediff.operators.prep import MAX_VOCABULARY


def _fit_persisted(estimator, data: DataFrame):
    """Iterative learners scan their input once per iteration: keep it (it can be
    recomputed from its lineage if an executor is lost) for the fit only."""
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


class Adapter:
    def fit(self, diffs: DataFrame, features: str = "features", label: str = "dy",
            weight: str | None = None) -> "Adapter":
        raise NotImplementedError

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        raise NotImplementedError

    def copy(self) -> "Adapter":
        return type(self)(**self.params())

    def params(self) -> dict:
        return {}


class ZeroAdapter(Adapter):
    def fit(self, diffs, features="features", label="dy", weight=None):
        return self

    def score(self, df, features="features"):
        return df.withColumn("dhat", F.lit(0.0))


class OlsAdapter(Adapter):
    """``dhat = slope * features[index] + intercept`` (one feature, exact SQL fit)."""

    def __init__(self, index: int = 0):
        self.index = index
        self.slope = 0.0
        self.intercept = 0.0

    def params(self):
        return {"index": self.index}

    def _x(self, features: str) -> Column:
        # Negative index counts from the end (e.g. -1 = appended distance).
        return F.element_at(F.col(features), self.index + 1 if self.index >= 0 else self.index)

    def fit(self, diffs, features="features", label="dy", weight=None):
        xf = self._x(features)
        if weight:
            # Weighted least squares via the same sums (copies counted w times).
            w = F.col(weight).cast("double")
            r = diffs.agg(F.sum(w).alias("n"), F.sum(w * xf).alias("sx"),
                          F.sum(w * F.col(label)).alias("sy"),
                          F.sum(w * xf * xf).alias("sxx"),
                          F.sum(w * xf * F.col(label)).alias("sxy")).first()
            n, sx, sy, sxx, sxy = (r["n"] or 0.0), r["sx"], r["sy"], r["sxx"], r["sxy"]
            den = n * sxx - sx * sx if n else 0.0
            self.slope = (n * sxy - sx * sy) / den if den else 0.0
            self.intercept = (sy - self.slope * sx) / n if n else 0.0
            return self
        r = diffs.agg(F.regr_slope(F.col(label), xf).alias("b"),
                      F.regr_intercept(F.col(label), xf).alias("a"),
                      F.avg(F.col(label)).alias("m")).first()
        if r["b"] is None or r["b"] != r["b"]:
            # Constant feature: the least-squares fit is the mean difference.
            self.slope, self.intercept = 0.0, float(r["m"]) if r["m"] is not None else 0.0
        else:
            self.slope, self.intercept = float(r["b"]), float(r["a"])
        return self

    def score(self, df, features="features"):
        return df.withColumn(
            "dhat", F.lit(self.slope) * self._x(features) + F.lit(self.intercept))


class LinearAdapter(Adapter):
    """Ridge least squares of the label on all features and an intercept.

    ``coef, intercept = argmin mean((y - x.coef - intercept)^2) + reg * |coef|^2``.  A task
    folds its rows into one Gram matrix of (x, 1, y), of which it hands on the upper triangle;
    the triangles are merged in two levels, and the driver solves one system as wide as
    the features (``MAX_WIDTH``, checked first).  Rows with a missing feature or label are
    left out; rows of another width are an error.
    """

    MAX_WIDTH = 2048
    #: Triangles that the driver adds up at most.
    MERGED = 32

    def __init__(self, reg: float = 1e-3):
        self.reg = float(reg)
        self.coef: np.ndarray = np.empty(0)
        self.intercept = 0.0

    def params(self):
        return {"reg": self.reg}

    def gram(self, rows: DataFrame, features: str, label: str, weight: str | None) -> np.ndarray | None:
        """Weighted sums of products of (x, 1, y), a symmetric matrix; None without rows."""
        size = F.size(F.col(features))
        r = rows.where(F.col(features).isNotNull()).agg(F.min(size), F.max(size)).first()
        if r[0] is None:
            return None
        if r[0] != r[1]:
            raise ValueError(f"feature vectors of {r[0]} to {r[1]} entries")
        width = int(r[1])
        if width > self.MAX_WIDTH:
            raise ValueError(f"{width} features; a linear adapter takes {self.MAX_WIDTH} at most")
        upper = np.triu_indices(width + 2)

        def fold(batches):
            total = np.zeros((width + 2, width + 2))
            for b in batches:
                x = b.column(0).cast(pa.list_(pa.float64()))
                if not len(x):
                    continue
                x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)
                y, w = (b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                m = np.column_stack([x, np.ones(len(x)), y])
                good = np.isfinite(m).all(axis=1) & np.isfinite(w)
                total += (m[good] * w[good, None]).T @ m[good]
            yield pa.RecordBatch.from_arrays([pa.array([total[upper].tolist()], pa.list_(pa.float64()))], names=["upper"])

        def merge(batches):
            total = np.zeros(len(upper[0]))
            for b in batches:
                for i in range(b.num_rows):
                    total += b.column(0)[i].values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["upper"])

        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        parts = (rows.where(F.col(features).isNotNull())
                 .select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
                 .mapInArrow(fold, "upper array<double>"))
        merged = parts.repartition(self.MERGED).mapInArrow(merge, "upper array<double>").collect()
        out = np.zeros((width + 2, width + 2))
        out[upper] = sum(np.array(r["upper"]) for r in merged)
        return out + np.triu(out, 1).T

    def fit(self, diffs, features="features", label="dy", weight=None):
        g = self.gram(diffs, features, label, weight)
        n = 0.0 if g is None else g[-2, -2]
        if n <= 0:
            self.coef, self.intercept = np.empty(0), 0.0
            return self
        a = g[:-1, :-1] / n
        a[np.arange(len(a) - 1), np.arange(len(a) - 1)] += self.reg
        solved = np.linalg.solve(a, g[:-1, -1] / n)
        self.coef, self.intercept = solved[:-1], float(solved[-1])
        return self

    def score(self, df, features="features"):
        if not len(self.coef):
            return df.withColumn("dhat", F.lit(self.intercept))
        products = F.zip_with(F.col(features), F.array(*[F.lit(float(c)) for c in self.coef]), lambda x, c: x * c)
        return df.withColumn("dhat", F.aggregate(products, F.lit(self.intercept), lambda a, v: a + v))


class TreeAdapter(Adapter):
    """Decision trees by distributed histograms, one per value of ``group``.

    All trees grow together, a level at a time: one job counts the training rows by
    (group, node, feature, bin, label), partially in each task, and a split is chosen from these
    counts by the largest Gini purity ``sum(left^2)/n_left + sum(right^2)/n_right`` (ties: the first
    feature, then the first bin).  Bins are of equal width between a feature's least and largest
    value.  The number of jobs follows the depth, not the groups; the model is a table with one
    row a group, and rows are scored by a join with it.  Rows of a group that was never seen get
    no row back; a missing feature lies in bin 0; labels of equal count go by the smallest.
    """

    def __init__(self, depth: int = 2, bins: int = 16, group: str | None = None):
        self.depth, self.bins, self.group = int(depth), int(bins), group
        self.table: DataFrame | None = None

    def params(self):
        return {"depth": self.depth, "bins": self.bins, "group": self.group}

    def _bin(self, value: Column, lo: Column, hi: Column) -> Column:
        at = F.floor((value - lo) * self.bins / (hi - lo))
        fits = value.isNotNull() & ~F.isnan(value) & (hi > lo)
        return F.when(fits, F.greatest(F.lit(0), F.least(F.lit(self.bins - 1), at))).otherwise(0).cast("int")

    def fit(self, diffs, features="features", label="dy", weight=None):
        from casediff.session import scratch_path
        spark = diffs.sparkSession

        def kept(df, name):
            path = scratch_path(spark, name)
            df.write.parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        g = F.col(f"`{self.group}`") if self.group else F.lit(0)
        w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
        rows = diffs.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
            g.alias("g"), F.col(features).alias("x"), F.col(label).alias("label"), w.alias("w"), F.lit(1).alias("node"))
        v = F.when(~F.isnan("v"), F.col("v"))
        ranges = kept(rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(
            F.min(v).alias("lo"), F.max(v).alias("hi")), "tree-ranges")
        splits = None
        for level in range(self.depth):
            best = kept(self._splits(self._down(rows, splits, level).where(F.col("node") >= 2 ** level), ranges), "tree-splits")
            splits = best if splits is None else splits.unionByName(best)
        leaves = self._down(rows, splits, self.depth)
        counts = leaves.groupBy("g", "node", "label").agg(F.sum("w").alias("n"))
        labels = counts.groupBy("g", "node").agg(
            F.min_by("label", F.struct((-F.col("n")).alias("n"), F.col("label").alias("l"))).alias("label"))
        out = labels.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("node", "label"))).alias("labels"))
        if splits is not None:
            out = out.join(splits.groupBy("g").agg(F.map_from_entries(F.collect_list(
                F.struct("node", F.struct("f", "b", "lo", "hi").alias("s")))).alias("splits")), "g", "left")
        else:
            out = out.withColumn("splits", F.lit(None).cast("map<int,struct<f:int,b:int,lo:double,hi:double>>"))
        self.table = kept(out, "trees")
        return self

    def _goes_left(self, x: Column, s: Column) -> Column:
        return self._bin(F.get(x, s["f"]), s["lo"], s["hi"]) < s["b"]

    def _down(self, rows: DataFrame, splits: DataFrame | None, levels: int) -> DataFrame:
        for _ in range(levels):
            rows = self._step(rows, splits)
        return rows

    def _step(self, rows: DataFrame, splits: DataFrame) -> DataFrame:
        """Rows moved to the child of their node, where it is split."""
        s = splits.select(F.col("g").alias("sg"), F.col("node").alias("sn"), F.struct("f", "b", "lo", "hi").alias("s"))
        j = rows.join(s, F.col("g").eqNullSafe(F.col("sg")) & (F.col("node") == F.col("sn")), "left")
        child = F.col("node") * 2 + F.when(self._goes_left(F.col("x"), F.col("s")), 0).otherwise(1)
        return j.select("g", "x", "label", "w", F.when(F.col("s").isNotNull(), child).otherwise(F.col("node")).alias("node"))

    def _splits(self, rows: DataFrame, ranges: DataFrame) -> DataFrame:
        """``g, node, f, b, lo, hi``: the best split of every node that has one; left is ``bin < b``."""
        cells = rows.select("g", "node", "label", "w", F.posexplode("x").alias("f", "v")).join(ranges, "f")
        hist = cells.groupBy("g", "node", "f", "lo", "hi", self._bin(F.col("v"), F.col("lo"), F.col("hi")).alias("bin"),
                             "label").agg(F.sum("w").alias("n"))
        by_label = rows.groupBy("g", "node", "label").agg(F.sum("w").alias("t"))
        node = by_label.groupBy("g", "node").agg(F.sum("t").alias("total"), F.sum(F.col("t") * F.col("t")).alias("squares"))
        # left counts of every cut after a bin
        cut = F.when(F.col("bin") < self.bins - 1, F.sequence(F.col("bin") + 1, F.lit(self.bins - 1))).otherwise(
            F.array().cast("array<int>"))
        left = hist.withColumn("b", F.explode(cut)).groupBy("g", "node", "f", "lo", "hi", "b", "label").agg(F.sum("n").alias("l"))
        t = by_label.select(F.col("g").alias("tg"), F.col("node").alias("tn"), F.col("label").alias("tl"), "t")
        left = left.join(t, F.col("g").eqNullSafe(F.col("tg")) & (F.col("node") == F.col("tn")) & (F.col("label") == F.col("tl")))
        sides = left.groupBy("g", "node", "f", "lo", "hi", "b").agg(
            F.sum("l").alias("nl"), F.sum(F.col("l") * F.col("l")).alias("sl"), F.sum(F.col("t") * F.col("l")).alias("tl"))
        node = node.select(F.col("g").alias("ng"), F.col("node").alias("nn"), "total", "squares")
        sides = sides.join(node, F.col("g").eqNullSafe(F.col("ng")) & (F.col("node") == F.col("nn")))
        nr, sr = F.col("total") - F.col("nl"), F.col("squares") - 2 * F.col("tl") + F.col("sl")
        purity = F.col("sl").cast("double") / F.col("nl").cast("double") + sr.cast("double") / nr.cast("double")
        sides = sides.where(nr > 0).withColumn("purity", purity).where(
            F.col("purity") > F.col("squares").cast("double") / F.col("total").cast("double") + 1e-9)
        best = F.min_by(F.struct("f", "b", "lo", "hi"), F.struct((-F.col("purity")).alias("p"), "f", "b"))
        return sides.groupBy("g", "node").agg(best.alias("s")).select("g", "node", "s.f", "s.b", "s.lo", "s.hi")

    def score(self, df, features="features"):
        g = F.col(f"`{self.group}`") if self.group else F.lit(0)
        model = self.table.select(F.col("g").alias("_tree_g"), F.col("splits").alias("_splits"), F.col("labels").alias("_labels"))
        j = df.withColumn("_g", g).join(model, F.col("_g").eqNullSafe(F.col("_tree_g"))).withColumn("_node", F.lit(1))
        for _ in range(self.depth):
            s = F.try_element_at(F.col("_splits"), F.col("_node"))
            child = F.col("_node") * 2 + F.when(self._goes_left(F.col(features), s), 0).otherwise(1)
            j = j.withColumn("_node", F.when(s.isNotNull(), child).otherwise(F.col("_node")))
        return j.withColumn("dhat", F.try_element_at(F.col("_labels"), F.col("_node"))).drop(
            "_g", "_tree_g", "_splits", "_labels", "_node")


class ModeAdapter(Adapter):
    """Most frequent target difference (ties -> smallest)."""

    def __init__(self):
        self.value = 0.0

    def fit(self, diffs, features="features", label="dy", weight=None):
        w = F.col(weight) if weight else F.lit(1)
        counts = diffs.groupBy(label).agg(F.sum(w).alias("n"))
        r = counts.agg(F.min_by(F.col(label), F.struct((-F.col("n")).alias("nn"),
                                                      F.col(label).alias("v"))).alias("m")).first()
        self.value = float(r["m"]) if r["m"] is not None else 0.0
        return self

    def score(self, df, features="features"):
        return df.withColumn("dhat", F.lit(self.value))


class MLAdapter(Adapter):
    """Any ``pyspark.ml`` regressor trained on ``features -> label`` (L1, L4)."""

    def __init__(self, estimator=None):
        if estimator is None:
            from pyspark.ml.regression import LinearRegression
            estimator = LinearRegression(maxIter=100, regParam=1e-6, elasticNetParam=0.0)
        self.estimator = estimator
        self.model = None

    def params(self):
        return {"estimator": self.estimator.copy()}

    def fit(self, diffs, features="features", label="dy", weight=None):
        est = self.estimator.copy()
        est.setFeaturesCol("_vec").setLabelCol("_label")
        if est.hasParam("predictionCol"):
            est.setPredictionCol("_pred")
        data = diffs.select(array_to_vector(features).alias("_vec"),
                            F.col(label).cast("double").alias("_label"),
                            *([F.col(weight).cast("double").alias("_w")] if weight else []))
        if weight and est.hasParam("weightCol"):
            est.set(est.getParam("weightCol"), "_w")
        elif weight:
            data = data.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_w").cast("int"))))
        self.model = _fit_persisted(est, data)
        return self

    def score(self, df, features="features"):
        scored = self.model.transform(df.withColumn("_vec", array_to_vector(features)))
        return scored.withColumn("dhat", F.col("_pred").cast("double")).drop("_vec", "_pred")


class MLClassAdapter(Adapter):
    """Any ``pyspark.ml`` classifier on the target difference as a class (L2).

    The distinct differences (at most 2 x classes) are indexed in sorted order;
    predictions map back to the difference value.  With
    ``hidden_layer_sizes`` the default learner is a multilayer perceptron.
    """

    def __init__(self, estimator=None, hidden_layer_sizes: Sequence[int] | None = (100,),
                 max_iter: int = 200, tol: float = 1e-4, seed: int | None = 0):
        self.estimator = estimator
        self.hidden_layer_sizes = tuple(hidden_layer_sizes or ())
        self.max_iter, self.tol, self.seed = max_iter, tol, seed
        self.values: list[float] = []
        self.model = None
        self.constant: float | None = None

    def params(self):
        return {"estimator": self.estimator.copy() if self.estimator else None,
                "hidden_layer_sizes": self.hidden_layer_sizes,
                "max_iter": self.max_iter, "tol": self.tol, "seed": self.seed}

    def _index(self, col: Column) -> Column:
        return (F.array_position(F.array(*[F.lit(v) for v in self.values]), col) - 1).cast("double")

    def fit(self, diffs, features="features", label="dy", weight=None):
        # The label set of a classifier is its class set; its size is checked while it is read.
        found = (diffs.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("double").alias("v"))
                 .agg(F.max(F.size(features)).alias("w")).limit(MAX_VOCABULARY + 1).collect())
        if len(found) > MAX_VOCABULARY:
            raise ValueError("too many distinct target differences for a classifier")
        self.values = sorted(r["v"] for r in found)
        if len(self.values) <= 1:
            # A single difference: constant adapter.
            self.constant = self.values[0] if self.values else 0.0
            return self
        width = max(r["w"] for r in found)
        est = self.estimator
        if est is None:
            from pyspark.ml.classification import MultilayerPerceptronClassifier
            est = MultilayerPerceptronClassifier(
                layers=[width, *self.hidden_layer_sizes, len(self.values)],
                maxIter=self.max_iter, tol=self.tol,
                **({"seed": self.seed} if self.seed is not None else {}))
        else:
            est = est.copy()
        est.setFeaturesCol("_vec").setLabelCol("_label").setPredictionCol("_pred")
        for p in ("probabilityCol", "rawPredictionCol"):
            if est.hasParam(p):
                est.set(est.getParam(p), "_" + p)
        data = diffs.select(array_to_vector(features).alias("_vec"),
                            self._index(F.col(label).cast("double")).alias("_label"),
                            *([F.col(weight).alias("_w")] if weight else []))
        if weight:
            if est.hasParam("weightCol"):
                est.set(est.getParam("weightCol"), "_w")
            else:
                data = data.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_w").cast("int"))))
        self.model = _fit_persisted(est, data)
        return self

    def score(self, df, features="features"):
        if self.constant is not None:
            return df.withColumn("dhat", F.lit(float(self.constant)))
        scored = self.model.transform(df.withColumn("_vec", array_to_vector(features)))
        vals = F.array(*[F.lit(v) for v in self.values])
        out = scored.withColumn("dhat", F.element_at(vals, F.col("_pred").cast("int") + 1))
        drop = ["_vec", "_pred", "_probabilityCol", "_rawPredictionCol"]
        return out.drop(*[c for c in drop if c in out.columns])


def make_adapter(name_or_adapter, task: str = "regression") -> Adapter:
    """``"zero" | "ols" | "mode" | "linear" | "tree" | "mlp"`` or an Adapter / ml estimator."""
    if isinstance(name_or_adapter, Adapter):
        return name_or_adapter.copy()
    if name_or_adapter is None:
        name_or_adapter = "linear" if task == "regression" else "mlp"
    if isinstance(name_or_adapter, str):
        n = name_or_adapter
        if n == "zero":
            return ZeroAdapter()
        if n == "ols":
            return OlsAdapter()
        if n == "mode":
            return ModeAdapter()
        if n == "linear":
            return LinearAdapter()
        if n == "tree":
            return TreeAdapter()
        if n == "mlp":
            return MLClassAdapter()
        raise ValueError(f"unknown adapter {n!r}")
    # a pyspark.ml estimator
    return MLAdapter(name_or_adapter) if task == "regression" else MLClassAdapter(name_or_adapter)
