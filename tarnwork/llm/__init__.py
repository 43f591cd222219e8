"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
