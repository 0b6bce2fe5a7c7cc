"""Helpers the operators share: tables in, scratch tables, row digests."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casediff.session import scratch_path

#: Word separators of the byte-exact contracts: space and the five ASCII controls 9-13.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later plans
    start from the files, so a lost executor does not repeat what went before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def digest128(text: Column) -> Column:
    """First 16 bytes of the SHA-256 of a string: the identity of a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def blank_words(text: Column) -> Column:
    """Words of a text: maximal runs without ``BLANKS``, unchanged."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")
