"""Operators for preparing training text. Nothing else in the library imports this package.

Task code of this package is pickled by value, so the workers of a cluster need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
