"""A PySpark-native engine for news intelligence and training-data preparation.

Functions of this package that run in executors are pickled by value, so workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
