"""Fitted models on disk: the case base and tables as Parquet, adapters, metric and parameters as metadata.

Everything is written and read by Spark, so a path may lie in any store that the
cluster shares.  Saving over an existing path is an error, as for Spark's writers.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from casediff.operators import adapters as A
from casediff.operators.knn import DistanceSpec
from casediff.operators.vdm import ProfileTable


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_spec(spark: SparkSession, spec: DistanceSpec, path: str) -> None:
    """The metric; its tables are one row per matrix row."""
    if any(isinstance(t, ProfileTable) for t in spec.tables):
        raise ValueError("a metric with class profiles is fitted again, not saved")
    write_json(spark, f"{path}/metadata", {"numeric": spec.numeric, "final": spec.final, "random_seed": spec.random_seed,
                                           "tables": len(spec.tables)})
    rows = [(f, i, [float(v) for v in row]) for f, t in enumerate(spec.tables) for i, row in enumerate(np.asarray(t))]
    if rows:
        write_table(spark.createDataFrame(rows, "f int, i int, row array<double>"), f"{path}/tables")


def load_spec(spark: SparkSession, path: str) -> DistanceSpec:
    meta = read_json(spark, f"{path}/metadata")
    tables: list[list] = [[] for _ in range(meta["tables"])]
    if tables:
        for r in read_table(spark, f"{path}/tables").orderBy("f", "i").collect():
            tables[r["f"]].append(r["row"])
    return DistanceSpec(numeric=meta["numeric"], final=meta["final"], random_seed=meta["random_seed"],
                        tables=tuple(np.array(t) for t in tables))


#: Adapters that are a few numbers: the attributes that make up their fitted state.
STATE = {"ZeroAdapter": (), "OlsAdapter": ("slope", "intercept"), "ModeAdapter": ("value",),
         "LinearAdapter": ("coef", "intercept"), "TreeAdapter": (), "MLAdapter": (), "MLClassAdapter": ("values", "constant")}


def save_adapter(spark: SparkSession, adapter: A.Adapter, path: str) -> None:
    kind = type(adapter).__name__
    if kind not in STATE:
        raise ValueError(f"cannot save an adapter of type {kind}")
    state = {n: v.tolist() if isinstance(v := getattr(adapter, n), np.ndarray) else v for n in STATE[kind]}
    params = {n: v for n, v in adapter.params().items() if n != "estimator"}
    model = getattr(adapter, "model", None)
    write_json(spark, f"{path}/metadata", {"type": kind, "params": params, "state": state, "model": model is not None})
    if model is not None:
        model.write().save(f"{path}/model")
    if kind == "TreeAdapter":
        write_table(adapter.table, f"{path}/trees")


def load_adapter(spark: SparkSession, path: str) -> A.Adapter:
    from pyspark.ml.util import DefaultParamsReader
    meta = read_json(spark, f"{path}/metadata")
    adapter = getattr(A, meta["type"])(**meta["params"])
    for name, value in meta["state"].items():
        setattr(adapter, name, np.array(value) if name == "coef" else value)
    if meta["model"]:
        adapter.model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    if meta["type"] == "TreeAdapter":
        adapter.table = read_table(spark, f"{path}/trees")
    return adapter
