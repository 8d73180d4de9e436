"""Tidewright: a Spark-native engine for ordered market series and, in ``llm``, text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
