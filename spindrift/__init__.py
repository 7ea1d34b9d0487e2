"""Spark-first analytics for content trends, media-pipeline data and training corpora.

Functions that run in Python workers travel by value, so executors need not
have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
