import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from casediff.session import local_session
    s = local_session(4, shuffle_partitions=8, app="casediff-tests")
    yield s
    s.stop()


def cases(spark, rows, with_codes=False):
    """``rows``: list of (id, x list, y)."""
    from pyspark.sql import types as T
    fields = [T.StructField("id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())),
              T.StructField("y", T.DoubleType())]
    return spark.createDataFrame([(int(i), [float(v) for v in x], float(y)) for i, x, y in rows],
                                 T.StructType(fields))
