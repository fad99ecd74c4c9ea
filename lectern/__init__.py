"""Passage retrieval on Spark: parse books into verses, encode, search,
learn from feedback.

Functions that run on executors (Arrow UDFs, ``mapInPandas`` bodies) are
pickled by value, so executors need neither this package installed nor the
driver's working directory on their path.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark: ship with --py-files
    pass
