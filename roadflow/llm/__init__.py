"""Operators for preparing language-model training data; nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors as they are, so no copy of it has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
