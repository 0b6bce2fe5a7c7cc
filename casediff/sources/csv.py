"""CSV case tables with a fixed schema (S1-S3); nothing is inferred."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, header: bool = True,
             sep: str = ",", null_value: str | None = None) -> DataFrame:
    """S1 (header) / S2 (no header: every line is data, names come from ``schema``)."""
    r = spark.read.schema(schema).option("header", header).option("sep", sep) \
        .option("mode", "PERMISSIVE")
    if null_value is not None:
        r = r.option("nullValue", null_value)
    return r.csv(path)


def read_csv_by_position(spark: SparkSession, path: str, names: Sequence[str],
                         types: Sequence[T.DataType], **kw) -> DataFrame:
    """Headerless file, columns named by position (no data row is lost)."""
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    return read_csv(spark, path, schema, header=False, **kw)


def read_csv_with_row_id(spark: SparkSession, path: str, schema: T.StructType,
                         id_name: str = "id", **kw) -> DataFrame:
    """S3: the first column is a row id; it becomes the case id column."""
    first = schema.fields[0]
    fields = [T.StructField(id_name, T.LongType(), first.nullable)] + list(schema.fields[1:])
    return read_csv(spark, path, T.StructType(fields), **kw)
