"""hitweave: a retrieval and analytics engine expressed as Spark DataFrames.

A query is an algebra over scored result sets; see ``hitweave.operators`` for the
algebra, ``hitweave.plans`` for the query languages and ``hitweave.sources`` for
the readers that turn files into records and field extents.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
