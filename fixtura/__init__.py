"""fixtura: a PySpark-native analytics engine for dated match data."""

import sys

from pyspark import cloudpickle

# Worker code travels with the task, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
