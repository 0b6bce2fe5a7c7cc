"""CSV sources (S1-S3) and the metrics sink (S6) round-trip through the scratch folder."""

from pyspark.sql import types as T

from casediff.session import scratch_path
from casediff.sources import csv as C
from casediff.sources.sinks import append_metrics


def test_headerless_csv_keeps_first_row(spark):
    path = scratch_path(spark, "t-noheader")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").coalesce(1) \
        .write.option("header", False).csv(path)
    df = C.read_csv_by_position(spark, path, ["k", "v"], [T.LongType(), T.StringType()])
    assert sorted(df.collect()) == [(1, "a"), (2, "b")]      # no data row lost (X1)


def test_row_id_csv_and_append_sink(spark):
    path = scratch_path(spark, "t-rowid")
    spark.createDataFrame([(7, 1.5)], "r long, v double").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("r", T.LongType()), T.StructField("v", T.DoubleType())])
    df = C.read_csv_with_row_id(spark, path, schema, header=True)
    assert df.columns == ["id", "v"] and df.first()["id"] == 7
    out = scratch_path(spark, "t-metrics")
    m = spark.createDataFrame([(1, "acc", 0.5)], "run int, metric string, value double")
    append_metrics(m, out)
    append_metrics(m, out)
    assert spark.read.schema("run INT, metric STRING, value DOUBLE").json(out).count() == 2
