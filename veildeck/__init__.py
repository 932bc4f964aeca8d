"""Veildeck: a Spark-native privacy analytics engine (detect, rewrite, audit)."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

#: Functions sent to executors carry their code, so that executors need not have this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
