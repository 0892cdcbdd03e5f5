"""Evidence analytics on Spark: carving, timelines, ledgers and media sampling as DataFrame jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel by value, so a cluster needs no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
