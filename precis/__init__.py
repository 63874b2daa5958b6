"""precis: extractive summaries, cleaning and ROUGE as Spark jobs."""

import sys as _sys

# The Arrow kernels and UDFs of this package are shipped to the Python
# workers by value, so executors need no copy of the package on their path.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: workers must import precis
    pass
