"""docsync: document inventory, change detection and delivery planning on Spark."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Send this package's functions to Python workers by value, so that executors which do
# not have it installed can still list, hash and read files.
register_pickle_by_value(sys.modules[__name__])
