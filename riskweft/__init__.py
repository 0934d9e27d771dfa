"""Portfolio analytics for policy-and-claims tables on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with the job, so the workers do
# not need this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
