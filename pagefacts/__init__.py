"""Page-evidence analytics on PySpark.

Functions that run in Python workers are shipped by value, so workers need Spark and the public libraries alone: nothing has to be
installed there, and the driver may run from any folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
