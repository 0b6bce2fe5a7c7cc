"""Estimators in the ``pyspark.ml`` style.

Input DataFrames carry ``id BIGINT, x ARRAY<DOUBLE>, y`` (and ``codes`` for a
mixed metric).  ``fit`` keeps the case base persisted (recomputable from its
lineage if an executor is lost) and the fitted adapter; ``transform`` adds a
``prediction`` column.

Parameters map from the reference estimators: ``n_neighbours_1 -> kFit``,
``n_neighbours_2 -> kPredict``, ``weighted_knn -> weighted``,
``addition_of_context -> context``, ``duplicated_on_distance -> duplicate``,
``additional_distance_column`` / ``additional_results_column ->
distanceColumn``; the custom-metric variants are the same classes with a
``spec`` (U7).  Unknown parameter names raise (U8).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casediff.operators.adapters import make_adapter
from casediff.operators.knn import EUCLIDEAN
from casediff.plans import learner as L
from casediff.plans import persistence as P
from casediff.session import checkpoint_root

_ALIASES = {
    "n_neighbours_1": "kFit", "n_neighbours_2": "kPredict", "weighted_knn": "weighted",
    "addition_of_context": "context", "duplicated_on_distance": "duplicate",
    "additional_distance_column": "distanceColumn", "additional_results_column": "distanceColumn",
}


class _DiffParams(Params):
    kFit = Param(Params._dummy(), "kFit", "neighbours per case when fitting",
                 typeConverter=TypeConverters.toInt)
    kPredict = Param(Params._dummy(), "kPredict", "neighbours per query when predicting",
                     typeConverter=TypeConverters.toInt)
    weighted = Param(Params._dummy(), "weighted", "inverse-distance aggregation",
                     typeConverter=TypeConverters.toBoolean)
    context = Param(Params._dummy(), "context", "V1: interleave the case with its differences",
                    typeConverter=TypeConverters.toBoolean)
    duplicate = Param(Params._dummy(), "duplicate", "V2: weight pairs by distance",
                      typeConverter=TypeConverters.toBoolean)
    distanceColumn = Param(Params._dummy(), "distanceColumn", "V3: append the distance",
                           typeConverter=TypeConverters.toBoolean)
    strategy = Param(Params._dummy(), "strategy", "kNN plan: auto | broadcast | tiles",
                     typeConverter=TypeConverters.toString)
    clampToKnown = Param(Params._dummy(), "clampToKnown",
                         "classification: a predicted label outside the known ones becomes the nearest known one",
                         typeConverter=TypeConverters.toBoolean)
    checkpointCases = Param(Params._dummy(), "checkpointCases",
                            "cut the case base's lineage with a reliable checkpoint",
                            typeConverter=TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(kFit=5, kPredict=5, context=False, duplicate=False,
                         distanceColumn=False, strategy="auto", checkpointCases=False, clampToKnown=False)

    def set_params(self, **kw):
        """U8: set by reference or Spark name; unknown names raise."""
        for name, value in kw.items():
            if name in ("adapter", "spec"):
                setattr(self, "_" + name, value)
                continue
            pname = _ALIASES.get(name, name)
            if not self.hasParam(pname):
                raise ValueError(f"unknown parameter {name!r}")
            self.set(self.getParam(pname), value)
        return self

    def get_params(self) -> dict:
        out = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        out["adapter"] = getattr(self, "_adapter", None)
        out["spec"] = getattr(self, "_spec", EUCLIDEAN)
        return out

    def _variant(self) -> L.Variant:
        return L.Variant(context=self.getOrDefault(self.context),
                         duplicate=self.getOrDefault(self.duplicate),
                         distance_column=self.getOrDefault(self.distanceColumn))


class _DifferenceEstimator(Estimator, _DiffParams):
    task = "regression"

    def __init__(self, *, adapter=None, spec=EUCLIDEAN, **kw):
        super().__init__()
        self._setDefault(weighted=self.task == "regression")
        self._adapter = adapter
        self._spec = spec
        self.set_params(**kw)

    def copy(self, extra=None):
        that = super().copy(extra)
        that._adapter, that._spec = self._adapter, self._spec
        return that

    def _fit(self, dataset: DataFrame) -> "DifferenceModel":
        if self.getOrDefault(self.checkpointCases):
            # A long-lived model: write the case base to the cluster's checkpoint
            # folder (spark.checkpoint.dir) so predictions never replay its lineage.
            checkpoint_root(dataset.sparkSession)
            cases = dataset.checkpoint(eager=True)
        else:
            cases = dataset.persist(StorageLevel.MEMORY_AND_DISK)
        variant = self._variant()
        model = DifferenceModel(cases, None, self.task, self._spec)
        self._copyValues(model)
        if self.getOrDefault(self.strategy) in ("auto", "broadcast"):
            try:
                # Ship the case base once: the training self join and every
                # later prediction reuse the same broadcast.
                model.broadcast_case_base()
            except ValueError:
                if self.getOrDefault(self.strategy) == "broadcast":
                    raise                       # too large: auto falls back to tiles
        model.adapter = L.fit_on_differences(
            cases, self.getOrDefault(self.kFit), make_adapter(self._adapter, self.task), variant,
            spec=self._spec, strategy=self.getOrDefault(self.strategy),
            case_base=getattr(model, "_prepared", None))
        return model


class DifferenceRegressor(_DifferenceEstimator):
    """LR: regression by corrected neighbours (inverse-distance mean by default)."""

    task = "regression"


class DifferenceClassifier(_DifferenceEstimator):
    """LC: classification by corrected neighbours (majority vote by default)."""

    task = "classification"


class DifferenceModel(Model, _DiffParams):
    def __init__(self, cases: DataFrame, adapter, task: str, spec=EUCLIDEAN):
        super().__init__()
        self.cases, self.adapter, self.task, self._spec = cases, adapter, task, spec

    def broadcast_case_base(self) -> "DifferenceModel":
        """Ship the case base to the executors once (size checked); later
        predictions, e.g. every micro-batch of a stream, reuse it."""
        from casediff.operators.knn import broadcast_cases
        self._prepared = broadcast_cases(self.cases, carry=[("n_x", "x"), ("n_y", "y")],
                                         k=self.getOrDefault(self.kPredict))
        return self

    def release(self) -> None:
        """Unpersist the case base and drop its broadcast; the model predicts no more."""
        self.cases.unpersist()
        prepared, self._prepared = getattr(self, "_prepared", None), None
        if prepared is not None:
            prepared.release()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cases = getattr(self, "_prepared", None) or self.cases
        scored = L.scored_query_pairs(dataset, cases, self.getOrDefault(self.kPredict),
                                      self.adapter, self._variant(), spec=self._spec,
                                      strategy=self.getOrDefault(self.strategy))
        pred = L.aggregate(scored, self.task, self.getOrDefault(self.weighted))
        if self.task == "classification" and self.getOrDefault(self.clampToKnown):
            pred = L.clamp_to_known(pred, self.cases.select("y"))
        return dataset.join(pred.withColumnRenamed("query_id", "id"), "id", "left")

    def predictions(self, dataset: DataFrame) -> DataFrame:
        """``(id, prediction)`` only."""
        return self._transform(dataset).select("id", "prediction")

    def save(self, path: str) -> None:
        """Write the model below ``path``: cases as Parquet, adapter, metric and parameters as metadata."""
        spark = self.cases.sparkSession
        P.write_table(self.cases, f"{path}/cases")
        P.save_adapter(spark, self.adapter, f"{path}/adapter")
        P.save_spec(spark, self._spec, f"{path}/spec")
        P.write_json(spark, f"{path}/metadata", {"task": self.task, "params": {
            p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}})

    @classmethod
    def load(cls, spark, path: str) -> "DifferenceModel":
        meta = P.read_json(spark, f"{path}/metadata")
        model = cls(P.read_table(spark, f"{path}/cases"), P.load_adapter(spark, f"{path}/adapter"), meta["task"],
                    P.load_spec(spark, f"{path}/spec"))
        for name, value in meta["params"].items():
            model.set(model.getParam(name), value)
        return model
