"""Talent-data analytics on Spark: DataFrame-to-DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so the package needs to be installed on the driver only
cloudpickle.register_pickle_by_value(sys.modules[__name__])
