"""Web pages to clean text, links, media and quality tables, on Spark."""

import sys

from pyspark import cloudpickle

# Python steps travel to the executors by value, so nothing has to be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
