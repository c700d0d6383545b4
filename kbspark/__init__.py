"""Knowledge-base retrieval, graph and usage analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel to the workers with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
