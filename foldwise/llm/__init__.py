"""Operators for training-data pipelines (sharding, archives, filters, dedup, packing).

Nothing else in the library imports this package.  Its functions travel to the
Python workers by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
