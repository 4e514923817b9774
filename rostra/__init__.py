"""rostra: timetable data processing expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the Python workers by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
