"""Operators of the engine."""

import sys

from pyspark import cloudpickle

# Executors get the functions that run in Python with the tasks; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
