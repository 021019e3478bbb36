"""Property-market analytics on Spark: cleaning, keyed upserts, marts and the questions asked of them."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
