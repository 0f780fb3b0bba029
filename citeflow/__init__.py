"""Spark engine for building, searching and evaluating a citable text corpus."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so that these need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
