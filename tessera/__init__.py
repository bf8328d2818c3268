"""Tessera: record linkage and analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
