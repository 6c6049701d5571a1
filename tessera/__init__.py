"""Tessera: a Spark-first engine for keyed model data (see README.md).

Python workers get this package's functions by value, so a cluster needs no
installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
