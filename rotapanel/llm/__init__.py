"""Operators for preparing training data at corpus scale."""
import sys

from pyspark import cloudpickle

# Executors may not have this package installed: send its functions along with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
