"""lexmill: full-text search, ranking and corpus processing as PySpark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions and classes of this package travel to Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
