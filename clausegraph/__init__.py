"""Answerability analytics on Spark: typed fact graphs, retrieval consensus, topology metrics and evaluation as DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel with their tasks, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
