"""Operators of a training-data pipeline over documents and web pages."""

import sys

from pyspark import cloudpickle

# Functions reach the executors by value, so only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
