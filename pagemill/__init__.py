"""pagemill: document-extraction analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so jobs also run
# where the package is installed on the driver alone.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
