"""Rules as column expressions."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers whole, so that these need not have it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
