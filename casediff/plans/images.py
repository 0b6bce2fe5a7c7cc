"""Image learners (U5 LIMC, U6 LIMR) and difference images.

Images are flat ``ARRAY<INT>`` pixel vectors plus a shape ``(h, w, c)``.
``fit`` returns the difference table (absolute difference image, signed
target difference) for an external model; ``predict`` scores the absolute
difference of every (query, neighbour) pair with that model inside an
Arrow-batched ``mapInPandas`` (the model sees ``(n, h, w, c)`` arrays) and
aggregates ``y_neighbour + prediction`` per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casediff.operators import differences as D
from casediff.operators import vote as V
from casediff.operators.knn import knn_join


def as_vectors(images: DataFrame) -> DataFrame:
    """``(id, px ARRAY<INT>, y)`` -> kNN input with ``x`` as doubles (pixels kept)."""
    return images.select("id", F.transform("px", lambda p: p.cast("double")).alias("x"),
                         "px", "y")


def fit_differences(images: DataFrame, k: int = 5, strategy: str = "auto") -> DataFrame:
    """U5/U6 fit: K1 on pixels, D10 ``|base - neighbour|`` (INT) and ``dy``."""
    cases = as_vectors(images)
    nb = knn_join(cases, cases, k, exclude_self=True, strategy=strategy,
                  keep=[("q_x", "px"), ("q_y", "y")], carry=[("n_x", "px"), ("n_y", "y")])
    return nb.select("query_id", "neighbour_id", "rank", "dist",
                     D.image_difference().alias("diff"),
                     (F.col("q_y") - F.col("n_y")).alias("dy"))


def query_differences(queries: DataFrame, cases: DataFrame, k: int = 5,
                      strategy: str = "auto") -> DataFrame:
    """K2 on pixels and ``|query - case|`` per pair, with ``n_y``."""
    q, c = as_vectors(queries), as_vectors(cases)
    nb = knn_join(q, c, k, strategy=strategy, keep=[("q_x", "px")],
                  carry=[("n_x", "px"), ("n_y", "y")])
    return nb.select("query_id", "neighbour_id", "rank", "dist", "n_y",
                     D.image_difference().alias("diff"))


def mean_differences(queries: DataFrame, cases: DataFrame, k: int = 5, exclude_self: bool = False,
                     strategy: str = "auto") -> DataFrame:
    """Per query the mean absolute difference image over its k nearest cases; ``exclude_self`` leaves out the
    query's own image where it is a case (equal id)."""
    nb = knn_join(as_vectors(queries), as_vectors(cases), k, exclude_self=exclude_self, strategy=strategy,
                  keep=[("q_x", "px")], carry=[("n_x", "px")])
    return D.mean_difference_image(nb)


def score_with_model(pairs: DataFrame, model, shape: tuple[int, int, int],
                     outputs: Sequence[float] | None = None) -> DataFrame:
    """``dhat`` from ``model.predict(diff reshaped to (n, h, w, c))`` per Arrow batch.

    Only the images go to Python and only the predictions come back.  A model
    with one output gives ``dhat`` itself; one with several scores the values of
    ``outputs`` (one per output), and ``dhat`` is the value with the best score.
    """
    h, w, c = shape

    @F.pandas_udf("double")
    def dhat(diffs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for diff in diffs:
            if len(diff) == 0:
                yield pd.Series([], dtype="float64")
                continue
            arr = np.stack([np.asarray(v, dtype=np.float64) for v in diff.values])
            pred = np.asarray(model.predict(arr.reshape(-1, h, w, c)), dtype=np.float64).reshape(len(diff), -1)
            if outputs is not None:
                if pred.shape[1] != len(outputs):
                    raise ValueError(f"the model has {pred.shape[1]} outputs, {len(outputs)} values are given")
                pred = np.asarray(outputs, dtype=np.float64)[pred.argmax(axis=1)]
            elif pred.shape[1] != 1:
                raise ValueError(f"the model has {pred.shape[1]} outputs: name their values")
            yield pd.Series(pred.reshape(-1))

    return pairs.withColumn("dhat", dhat("diff"))


def predict(queries: DataFrame, cases: DataFrame, model, shape, *, task: str,
            k: int = 5, strategy: str = "auto", outputs: Sequence[float] | None = None) -> DataFrame:
    """A6 (vote, ties -> nearest) or A7 (mean) on ``n_y + dhat``."""
    scored = score_with_model(query_differences(queries, cases, k, strategy), model, shape, outputs)
    value = F.col("n_y").cast("double") + F.col("dhat")
    if task == "classification":
        return V.majority_vote(scored, value)
    return V.mean_value(scored, value)


class MeanPixelModel:
    """A tiny external model: mean absolute pixel difference / 255 (deterministic)."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), -1).mean(axis=1) / 255.0


class PixelBandModel:
    """An integer-valued external model: ``floor(mean difference / 64)``."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.floor(x.reshape(len(x), -1).mean(axis=1) / 64.0)
