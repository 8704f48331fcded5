"""spanlake: evidence retrieval and span analytics as Spark DataFrame transforms."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions for Python workers travel by value, so that executors need no copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
