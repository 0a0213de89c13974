"""Operators for preparing training data: scoring, de-duplication, filtering, mixing, packing, search.

Nothing outside this folder imports it; its queries are in :mod:`palimpsest.llm.catalog`.
"""

import sys

from pyspark import cloudpickle

# Python workers get these functions with the task, so a cluster needs no copy of the package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
