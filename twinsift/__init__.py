"""Duplicate and near-duplicate analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel with the job, so that executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from . import functions, operators, plans, sources  # noqa: E402

__all__ = ["functions", "operators", "plans", "sources"]
__version__ = "0.1.0"
