"""Analytics over ordered, numeric-plus-label series on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: an executor needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
