"""Operators of a training-data pipeline, each a ``DataFrame -> DataFrame`` job.

Nothing else in the library imports this subpackage.  Kernels that run in
Python workers are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
