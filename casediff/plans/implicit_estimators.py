"""Implicit and image learners in the ``pyspark.ml`` style (U3-U6), with saving and loading.

``ImplicitClassifier`` (U3) and ``ImplicitRegressor`` (U4, on segments of the
target) take ``id, x, y``; ``ImageClassifier`` (U5) and ``ImageRegressor`` (U6) take
``id, px ARRAY<INT>, y`` and an external model for difference images.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame

from casediff.operators.adapters import TreeAdapter
from casediff.operators.discretise import EqualFrequency, EqualWidth
from casediff.operators.knn import EUCLIDEAN
from casediff.plans import images as IM
from casediff.plans import implicit as I
from casediff.plans import persistence as P

_ALIASES = {"n_neighbours_1": "kFit", "n_neighbours_2": "kPredict", "random_pairs": "randomPairs",
            "single_pair": "singlePair"}


class _Named(Params):
    """Parameters by Spark's or the reference's names; unknown names raise."""

    def set_params(self, **kw):
        for name, value in kw.items():
            pname = _ALIASES.get(name, name)
            if not self.hasParam(pname):
                raise ValueError(f"unknown parameter {name!r}")
            self.set(self.getParam(pname), value)
        return self

    def get_params(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}


class _ImplicitParams(_Named):
    nNeighbours = Param(Params._dummy(), "nNeighbours", "cases of each class for a query", TypeConverters.toInt)
    singlePair = Param(Params._dummy(), "singlePair", "one case of each class", TypeConverters.toBoolean)
    randomPairs = Param(Params._dummy(), "randomPairs", "random cases of each class", TypeConverters.toBoolean)
    seed = Param(Params._dummy(), "seed", "seed of the random cases", TypeConverters.toInt)
    adapter = Param(Params._dummy(), "adapter", "mode | tree", TypeConverters.toString)
    depth = Param(Params._dummy(), "depth", "depth of the trees", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of a feature", TypeConverters.toInt)
    strategy = Param(Params._dummy(), "strategy", "kNN plan: auto | broadcast | cells | tiles", TypeConverters.toString)
    nSegments = Param(Params._dummy(), "nSegments", "segments of a regression target", TypeConverters.toInt)
    equalDivision = Param(Params._dummy(), "equalDivision", "segments of equal frequency, else of equal width",
                          TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(nNeighbours=5, singlePair=False, randomPairs=False, seed=0, adapter="tree", depth=2, bins=16,
                         strategy="auto", nSegments=3, equalDivision=True)


class ImplicitClassifier(Estimator, _ImplicitParams):
    """Case pairs per source class, one adapter a class, a vote over all classes."""

    regression = False

    def __init__(self, spec=EUCLIDEAN, **kw):
        super().__init__()
        self._spec = spec
        self.set_params(**kw)

    def copy(self, extra=None):
        that = super().copy(extra)
        that._spec = self._spec
        return that

    def _fit(self, dataset: DataFrame) -> "ImplicitLearnerModel":
        get = self.getOrDefault
        segments = None
        if self.regression:
            segments = (EqualFrequency if get(self.equalDivision) else EqualWidth)(get(self.nSegments)).fit(dataset, "y")
            dataset = dataset.withColumn("y", segments.segment("y"))
        adapter = get(self.adapter)
        if adapter not in ("mode", "tree"):
            raise ValueError(f"unknown adapter {adapter!r}")
        inner = I.fit_implicit(dataset, adapter=TreeAdapter(get(self.depth), get(self.bins)) if adapter == "tree" else adapter,
                               n_neighbours=get(self.nNeighbours), single_pair=get(self.singlePair),
                               random_pairs=get(self.randomPairs), seed=get(self.seed), spec=self._spec,
                               strategy=get(self.strategy))
        model = ImplicitLearnerModel(inner, segments)
        self._copyValues(model)
        return model


class ImplicitRegressor(ImplicitClassifier):
    """U4: the implicit classifier on segments of the target; it predicts the segment's number."""

    regression = True


class ImplicitLearnerModel(Model, _ImplicitParams):
    def __init__(self, inner: I.ImplicitModel, segments=None):
        super().__init__()
        self.inner, self.segments = inner, segments

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.join(self.inner.predict(dataset).withColumnRenamed("query_id", "id"), "id", "left")

    def predictions(self, dataset: DataFrame) -> DataFrame:
        """``(id, prediction)`` only."""
        return self.inner.predict(dataset).withColumnRenamed("query_id", "id").select("id", "prediction")

    def release(self) -> None:
        self.inner.release()

    def save(self, path: str) -> None:
        spark, m = self.inner.pools.sparkSession, self.inner
        P.write_table(m.pools, f"{path}/pools")
        if m.modes is not None:
            P.write_table(m.modes, f"{path}/modes")
        if m.trees is not None:
            P.save_adapter(spark, m.trees, f"{path}/trees")
        P.save_spec(spark, m.spec, f"{path}/spec")
        kind = None if self.segments is None else type(self.segments).__name__
        P.write_json(spark, f"{path}/metadata", {
            "params": self.get_params(), "modes": m.modes is not None, "trees": m.trees is not None,
            "segments": kind and {"type": kind, "state": {k: v for k, v in vars(self.segments).items()}}})

    @classmethod
    def load(cls, spark, path: str) -> "ImplicitLearnerModel":
        meta = P.read_json(spark, f"{path}/metadata")
        params = meta["params"]
        segments = None
        if meta["segments"]:
            segments = {"EqualFrequency": EqualFrequency, "EqualWidth": EqualWidth}[meta["segments"]["type"]](params["nSegments"])
            vars(segments).update(meta["segments"]["state"])
        inner = I.ImplicitModel(
            pools=P.read_table(spark, f"{path}/pools"), classes=[], n_neighbours=params["nNeighbours"],
            single_pair=params["singlePair"], random_pairs=params["randomPairs"], seed=params["seed"],
            spec=P.load_spec(spark, f"{path}/spec"), strategy=params["strategy"],
            modes=P.read_table(spark, f"{path}/modes") if meta["modes"] else None,
            trees=P.load_adapter(spark, f"{path}/trees") if meta["trees"] else None)
        model = cls(inner, segments)
        model.set_params(**params)
        return model


class _ImageParams(_Named):
    kFit = Param(Params._dummy(), "kFit", "neighbours per image when fitting", TypeConverters.toInt)
    kPredict = Param(Params._dummy(), "kPredict", "neighbours per query image", TypeConverters.toInt)
    strategy = Param(Params._dummy(), "strategy", "kNN plan: auto | broadcast | cells | tiles", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(kFit=5, kPredict=5, strategy="auto")


class ImageClassifier(Estimator, _ImageParams):
    """Votes of neighbours' labels corrected by an external model of difference images.

    ``train``: optional function of the table of difference images (``fit_differences``) that returns the model;
    without it ``model`` is used as it is."""

    task = "classification"

    def __init__(self, model=None, shape=(8, 8, 1), outputs=None, train=None, **kw):
        super().__init__()
        self._model, self._shape, self._outputs, self._train = model, tuple(shape), outputs, train
        self.set_params(**kw)

    def copy(self, extra=None):
        that = super().copy(extra)
        that._model, that._shape, that._outputs, that._train = self._model, self._shape, self._outputs, self._train
        return that

    def _fit(self, dataset: DataFrame) -> "ImageLearnerModel":
        external = self._model
        if self._train is not None:
            external = self._train(IM.fit_differences(dataset, self.getOrDefault(self.kFit), self.getOrDefault(self.strategy)))
        model = ImageLearnerModel(dataset, external, self._shape, self.task, self._outputs)
        self._copyValues(model)
        return model


class ImageRegressor(ImageClassifier):
    """The mean of the corrected labels."""

    task = "regression"


class ImageLearnerModel(Model, _ImageParams):
    def __init__(self, cases: DataFrame, external, shape, task: str, outputs=None):
        super().__init__()
        self.cases, self.external, self.shape, self.task, self.outputs = cases, external, tuple(shape), task, outputs

    def predictions(self, dataset: DataFrame) -> DataFrame:
        """``(id, prediction)`` only."""
        p = IM.predict(dataset, self.cases, self.external, self.shape, task=self.task, k=self.getOrDefault(self.kPredict),
                       strategy=self.getOrDefault(self.strategy), outputs=self.outputs)
        return p.withColumnRenamed("query_id", "id").select("id", "prediction")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.join(self.predictions(dataset), "id", "left")

    def save(self, path: str) -> None:
        """The case base and parameters; the external model is the caller's and is given again to ``load``."""
        P.write_table(self.cases, f"{path}/cases")
        P.write_json(self.cases.sparkSession, f"{path}/metadata", {
            "params": self.get_params(), "shape": list(self.shape), "task": self.task,
            "outputs": None if self.outputs is None else [float(x) for x in self.outputs]})

    @classmethod
    def load(cls, spark, path: str, external) -> "ImageLearnerModel":
        meta = P.read_json(spark, f"{path}/metadata")
        model = cls(P.read_table(spark, f"{path}/cases"), external, meta["shape"], meta["task"], meta["outputs"])
        model.set_params(**meta["params"])
        return model
