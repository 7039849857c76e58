"""dossier: permission-aware document intelligence as Spark jobs.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns).
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
