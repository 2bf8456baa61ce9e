"""Text-to-text corpus preparation and evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The row helpers travel with the jobs that use them, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
