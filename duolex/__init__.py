"""duolex: parallel-text corpus analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python functions that run on executors travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
