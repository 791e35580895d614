"""Spark jobs that turn search hits and fetched pages into verified people records."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
