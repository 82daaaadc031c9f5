"""Operators for training-data corpora; nothing else in the library depends on them.

Task code is sent by value, so executors need numpy and the named public libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
