"""peerskill: peer-benchmark and recommendation jobs on Spark."""

import sys as _sys

# The only Python that runs in tasks is the pandas KNN kernel.  Registering
# the package for pickle-by-value ships that code (and the helpers it calls)
# inside the task, so executors do not need the package installed or on
# their path - the same effect as --py-files, for classic and Connect sessions.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError):  # older cloudpickle: ship with --py-files instead
    pass
