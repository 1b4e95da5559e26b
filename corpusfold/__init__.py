"""Group a corpus of documents by what they say, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run on the workers travel with their job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
