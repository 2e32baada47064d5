"""Training-corpus operators.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Worker functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
