"""Column-expression helpers (all JVM-side, codegen friendly)."""

from casediff.functions.arrays import (
    array_absdiff, array_sub, as_double_array, concat_arrays, interleave,
    onehot, onehot_index, rank_key, sq_dist,
)

__all__ = [
    "array_absdiff", "array_sub", "as_double_array", "concat_arrays", "interleave",
    "onehot", "onehot_index", "rank_key", "sq_dist",
]
