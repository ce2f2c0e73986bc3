"""corpusloom: a knowledge corpus of linked markdown documents as Spark tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job: executors need no copy of this package,
# only the libraries of requirements.txt.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
