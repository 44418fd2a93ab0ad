"""Operators for preparing text corpora.

Functions that run in Python workers are sent by value, so executors need the libraries but not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
