"""Searchable memory over conversations, notes and source code, as lazy Spark plans."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
