"""Evidence retrieval, claim graphs and evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no installed copy: helpers travel inside the pickled functions.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
