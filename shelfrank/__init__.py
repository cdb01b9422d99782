"""shelfrank: a PySpark-native engine for ranking, matching and auditing product catalogues."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
