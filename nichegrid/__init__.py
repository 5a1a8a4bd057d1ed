"""nichegrid: species distribution modelling as ordinary Spark jobs.

Rasters are tables keyed by grid cell, occurrences are tables of points, and every
operator is a ``DataFrame -> DataFrame`` function.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
