"""Operators for large training corpora: formatting, packing, decontamination,
token files, scoring, search, line and document dedup, sharding, licence scans.
Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get this subpackage's functions with the tasks; they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
