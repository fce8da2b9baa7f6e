"""Heliograph: a Spark-native engine for media catalogues and the data pipelines around them."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
