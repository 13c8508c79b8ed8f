"""leafgraph: a PySpark-native engine for graphs of document objects, byte streams and images.

Functions and classes of the package travel to Python workers by value, so that the executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
