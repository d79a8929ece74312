"""Corpus curation, decision evaluation and request-log analytics on Spark.

Functions that run inside Python workers are pickled by value: executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
