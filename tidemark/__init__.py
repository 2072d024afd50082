"""tidemark: point-in-time features, quality checks, retrieval and lineage on Spark.

Every operator takes and returns Spark DataFrames and stays lazy unless its
docstring says it runs a job.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their task, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
