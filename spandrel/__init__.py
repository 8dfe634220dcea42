"""Spandrel: document analytics, retrieval and register queries as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
