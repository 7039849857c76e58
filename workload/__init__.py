"""Every operator as a query over the supplied tables, with the same thing in SQL."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
