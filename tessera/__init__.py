"""tessera: versioned numeric-array analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no
# copy of the package on its workers' import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
