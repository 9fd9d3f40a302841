"""Operators for training-data pipelines: each module holds one operator and the query that applies it.

Functions that run in tasks travel by value, so executors need Spark, NumPy and PyArrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
