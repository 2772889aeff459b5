"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Functions of this package travel to Python workers by value, so executors need
its public dependencies but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
