"""PySpark-native governance analytics for large file corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel with their tasks; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
