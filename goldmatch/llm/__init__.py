"""Operators for training-data pipelines: formatting, tokens, quality, dedup, mixing, packing, search.

Functions of this package that run inside tasks travel by value, so executors need no copy
of it. They refer to other functions by name rather than through a module.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
