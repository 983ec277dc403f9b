"""Security-event analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
