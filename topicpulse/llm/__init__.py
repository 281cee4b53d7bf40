"""Operators of a training-data pipeline, each ``DataFrame -> DataFrame``.

Nothing else in the package imports this subpackage.  Its task-side code is
shipped to the Python workers by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
