"""Lodestone: retrieval analytics as Spark DataFrame plans.

Functions that run on executors are pickled by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
