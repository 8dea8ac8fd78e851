"""Readers, writers, configuration and the event generator."""

import sys

from pyspark import cloudpickle

# Executors may not have this package on their path: ship the generator's functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
