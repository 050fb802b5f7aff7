"""pagelake: tables and streams of web pages on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
