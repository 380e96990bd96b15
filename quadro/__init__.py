"""Tabulation, record transformation and statistics of microdata as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code: workers needn't have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
