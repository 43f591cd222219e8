"""A Spark engine for record matching, table upkeep and corpus preparation."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
