"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``queries`` registers one
query per operator; every operator module also has a general interface.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel whole, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
