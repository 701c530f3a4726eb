"""corpusflow: build, search and measure text corpora with PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so the package needs to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
