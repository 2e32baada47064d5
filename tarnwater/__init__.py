"""tarnwater: a Spark-first engine for record cleaning, retrieval and corpus preparation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Worker functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
