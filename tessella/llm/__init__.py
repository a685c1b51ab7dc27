"""Training-data operators; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions by value: executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
