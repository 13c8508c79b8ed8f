"""Operators of a training-data pipeline; nothing outside this subpackage imports it.

Functions and classes of the subpackage travel to Python workers by value, so that the executors need not have it
installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
