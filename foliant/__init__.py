"""Passage retrieval and library analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the Python workers by value, so no executor needs it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
