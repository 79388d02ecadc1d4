"""Document analytics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
