"""Ensemble and uncertainty analytics on Spark DataFrames.

Functions sent to Python workers travel by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
