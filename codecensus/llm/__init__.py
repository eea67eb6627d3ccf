"""Operators for preparing training text at scale. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with their code, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
