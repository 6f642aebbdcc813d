"""Spark-native operators for rollout analytics, dataset building and evaluation."""

import sys

from pyspark.cloudpickle import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel inside the plans that use them: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
