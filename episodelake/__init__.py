"""Episode and notebook data quality as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: the workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
