"""Grouping of large collections of short texts, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from kindred.params import Params

# Functions shipped to Python workers travel with the task, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params"]
