"""Content curation on Spark: feeds in, ranked digests and similarity search out.

Every operator is a plain function from DataFrames to DataFrames. Nothing here
holds state; the caller reads the tables and decides where results are written.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent with their code, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
