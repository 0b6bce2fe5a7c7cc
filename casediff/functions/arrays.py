"""Array column expressions used by the difference projections and metrics.

All of them are built from Spark higher-order functions (``zip_with``,
``transform``, ``aggregate``), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double_array(col: ColumnLike) -> Column:
    """``ARRAY<FLOAT|INT>`` -> ``ARRAY<DOUBLE>`` (before any arithmetic)."""
    return F.transform(_c(col), lambda v: v.cast("double"))


def array_sub(a: ColumnLike, b: ColumnLike) -> Column:
    """Element-wise ``a - b`` (signed difference, D1/D3)."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def array_absdiff(a: ColumnLike, b: ColumnLike) -> Column:
    """Element-wise ``abs(a - b)`` (difference images, D10)."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))


def sq_dist(a: ColumnLike, b: ColumnLike) -> Column:
    """Squared Euclidean distance of two equal-length arrays (M1 before the root)."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def interleave(a: ColumnLike, b: ColumnLike) -> Column:
    """``[a1, b1, a2, b2, ...]`` (context interleave, D4/D5)."""
    return F.flatten(F.zip_with(_c(a), _c(b), lambda x, y: F.array(x, y)))


def concat_arrays(*cols: ColumnLike) -> Column:
    return F.concat(*[_c(c) for c in cols])


def onehot(col: ColumnLike, vocabulary: Sequence[str]) -> Column:
    """One-hot over a fixed sorted vocabulary; unknown or null -> all zeros (P10)."""
    c = _c(col)
    if not vocabulary:
        return F.array().cast("array<double>")
    # One higher-order function over a literal array: the expression size does
    # not grow with the vocabulary.
    vocab = F.array(*[F.lit(v) for v in vocabulary])
    return F.transform(vocab, lambda v: F.when(v == c, F.lit(1.0)).otherwise(F.lit(0.0)))


def onehot_index(idx: ColumnLike, n: int) -> Column:
    """One-hot of an integer label in ``[0, n)``."""
    i = _c(idx)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda j: (j == i).cast("double"))


def rank_key(d2: ColumnLike) -> Column:
    """Ordering key for neighbours: squared distance rounded to 9 places.

    Equal distances computed in a different summation order rank
    identically; the neighbour id breaks the remaining ties.
    """
    return F.round(_c(d2), 9)
