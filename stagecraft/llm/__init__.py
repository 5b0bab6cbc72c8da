"""Operators and queries of a large-scale training-data pipeline.

One module per operator.  Every operator takes DataFrames and column names and returns a DataFrame; the
thin queries over the driver tables, with their SQL, are in ``queries``.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this subpackage's code, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
