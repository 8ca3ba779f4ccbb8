"""Operators for building training corpora from documents, pages and vectors.

Functions that run inside Spark's Python tasks are shipped by value, so the
executors need numpy and pyarrow but not this package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
