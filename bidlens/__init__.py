"""Tender analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so a job also runs where
# this package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
