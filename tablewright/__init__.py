"""Tabular analytics as Spark jobs: plans, cleaning, profiles, keys and corpora."""

import sys

from pyspark import cloudpickle

# Functions which run in Python workers travel with their code, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
