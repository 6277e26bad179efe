"""Operators for preparing training data: scoring, deduplication, cleaning, mixing and formatting of texts."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors whole, so these need the libraries it uses but not the package itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
