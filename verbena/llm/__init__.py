"""Corpus operators for training data; nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
