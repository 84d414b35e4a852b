"""Corpus index and semantic search as PySpark DataFrame jobs.

Every operator takes and returns DataFrames (or Columns), stays lazy unless its
docstring says otherwise, and leaves the physical plan to Catalyst and AQE.
"""

import sys

from pyspark import cloudpickle

# Arrow tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
