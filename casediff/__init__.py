"""casediff: case-based prediction on Apache Spark.

Nearest-neighbour retrieval (distributed kNN joins) combined with a learned
correction trained on the differences between neighbouring cases.  Every step
is a DataFrame operation; the only Python inside tasks is a vectorised NumPy
distance kernel that runs per tile of the kNN join.
"""

from casediff.schema import CaseSchema

__all__ = [
    "CaseSchema", "knn_join", "self_knn", "broadcast_cases",
    "DifferenceRegressor", "DifferenceClassifier", "fit_implicit", "fit_preparation",
]
__version__ = "0.1.0"


def __getattr__(name):
    # Lazy exports: importing the package does not pull in pyspark.ml.
    if name in ("knn_join", "self_knn", "broadcast_cases"):
        from casediff.operators import knn
        return getattr(knn, name)
    if name in ("DifferenceRegressor", "DifferenceClassifier"):
        from casediff.plans import estimators
        return getattr(estimators, name)
    if name == "fit_implicit":
        from casediff.plans.implicit import fit_implicit
        return fit_implicit
    if name == "fit_preparation":
        from casediff.operators.prep import fit_preparation
        return fit_preparation
    raise AttributeError(name)
