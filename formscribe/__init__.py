"""Format learning and validation for key-value tables, written as Spark DataFrame operators."""
import sys

from pyspark import cloudpickle

from formscribe.config import SMALL_DATA, Settings

# Python functions used inside tasks travel with the plan, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings", "SMALL_DATA"]
