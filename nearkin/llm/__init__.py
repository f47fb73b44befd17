"""Operators of a training-data pipeline. Nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Executors get the code with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
