"""Telltale: evidence for vehicle incidents, computed with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
