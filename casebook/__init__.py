"""Model exploration on case-by-feature tables, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

from casebook.spec import MatrixSpec

# The few helpers that run inside tasks travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["MatrixSpec"]
