"""Operators a training-data pipeline needs, as Spark jobs.  Nothing else in the library imports this."""

from pyspark import cloudpickle

import vouchspark

# Python workers need not have the package on their path: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(vouchspark)
