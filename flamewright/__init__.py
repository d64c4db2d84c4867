"""Browser-trace analytics on Spark: trace events as DataFrames, every question a plan over them."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
