"""Property tests: blocked kNN == broadcast kNN == brute force on random inputs."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from casediff.operators.knn import knn_join
from conftest import cases
from test_knn import brute, got


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(3, 40), dim=st.integers(1, 30), k=st.integers(1, 6), seed=st.integers(0, 10_000),
       tile=st.integers(2, 12))
def test_tiles_equal_broadcast_equal_brute(spark, n, dim, k, seed, tile):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)), 1)        # coarse values: many ties
    ids = rng.permutation(10 * n)[:n] + 1
    df = cases(spark, [(int(i), x[j], 0) for j, i in enumerate(ids)])
    want = brute(ids, x, ids, x, k, exclude_self=True)
    a = got(knn_join(df, df, k, exclude_self=True, strategy="broadcast"))
    b = got(knn_join(df, df, k, exclude_self=True, strategy="tiles", tile_rows=tile))
    assert a == want and b == want
