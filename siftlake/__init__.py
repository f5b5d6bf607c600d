"""siftlake: hybrid search and data processing over lake tables, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to Python workers by value, so executors need no installed copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
