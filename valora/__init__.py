"""valora: a PySpark engine that cleans, cuts, scores and rolls up collections of text reports."""

import sys

from pyspark.cloudpickle import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel to the executors with their code, so that executors need
# no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
