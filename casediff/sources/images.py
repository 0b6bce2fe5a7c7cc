"""Image tensors as flat pixel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten_image(col: str | Column, depth: int = 3) -> Column:
    """Nested ``ARRAY<ARRAY<...>>`` image (h, w, c) -> flat pixel array."""
    c = F.col(col) if isinstance(col, str) else col
    for _ in range(depth - 1):
        c = F.flatten(c)
    return c


def pseudo_image(col: str | Column) -> Column:
    """Pixels from a float vector in [-1, 1]: ``round((v + 1) * 127.5)`` as INT 0-255.

    Used to treat a 64-float embedding as an 8x8x1 image in tests and queries.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda v: F.least(F.lit(255), F.greatest(
        F.lit(0), F.round((v.cast("double") + 1.0) * 127.5, 0).cast("int"))))


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw image files as ``(path, content BINARY)`` for a caller-side decoder."""
    return spark.read.format("binaryFile").load(path)
