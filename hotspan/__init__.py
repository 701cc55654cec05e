"""Event-rate hotspot analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers with their code, so
# the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
