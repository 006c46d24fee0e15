"""Sensor-table analytics on PySpark: every operator is a DataFrame function."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in tasks travel with them, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
