"""kindred: item recommendation and text similarity as lazy Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so executors need
# pandas, numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
