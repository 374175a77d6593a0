"""pixelframe: collections of images as DataFrames, and the operators around them."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry the library's code with them; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
