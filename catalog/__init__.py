"""Queries over the given tables, and the SQL that checks them."""

import sys

import reportweave
from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the workers need
# neither package on their path.
cloudpickle.register_pickle_by_value(reportweave)
cloudpickle.register_pickle_by_value(sys.modules[__name__])
