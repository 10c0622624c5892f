"""Graph prefix search and corpus operators as Spark DataFrame plans.

The few Python functions that tasks run reach workers by value, so executors need no
copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
