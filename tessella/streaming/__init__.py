"""Structured Streaming: keyed state of tiles and views, windows, joins of streams, sinks."""

import sys

from pyspark import cloudpickle

# workers get the processors by value: they need not have the library installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
