"""Operators for building training corpora: filters, deduplication, search and packing."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so that
# no copy of the package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
