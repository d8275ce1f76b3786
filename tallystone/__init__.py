"""Spark-first analytics over supplier quotations."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
