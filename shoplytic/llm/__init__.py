"""Preparing text corpora for language-model training, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors as they are, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
