"""Media analytics on Spark: DataFrame operators over time-ordered media tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# task functions travel by value, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
