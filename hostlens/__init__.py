"""hostlens: forensic artifact analytics on Spark.

Functions of this package that run inside Python workers (Arrow UDFs,
``mapInPandas`` steps) are shipped *by value*, so executors need no copy of
the package on their Python path (a plain ``spark-submit`` of the driver is
enough).
"""

import sys as _sys

try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older cloudpickle: ship the package with --py-files instead
    pass
