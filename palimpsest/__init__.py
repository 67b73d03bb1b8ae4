"""Palimpsest: reversible text pseudonymisation over Spark DataFrames.

Its Python functions are pickled by value, so executors need no copy of the
library on their path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
