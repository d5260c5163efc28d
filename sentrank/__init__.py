"""Spark-native ranking of security alerts under a review budget."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
