"""Geospatial hotspot analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python workers receive this package's functions by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
