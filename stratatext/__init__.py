"""Edition-aware corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers that run in tasks travel with the job, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
