"""askgrid: bulk document question answering and its evaluation, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
