"""Palimpsest: build, clean, cluster and annotate text-edit corpora on Spark.

Every public function takes and returns DataFrames (or Columns); nothing
collects a corpus to the driver.
"""

import sys

from pyspark import cloudpickle

# Helpers travel to the tasks with the code that uses them, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
