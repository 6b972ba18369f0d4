"""Race-track scoring and analytics for GPS flight tracks, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the plan, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
