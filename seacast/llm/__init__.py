"""Operators of a training-data pipeline: quality, fixity, deduplication, token files, packing, mixing, chat."""

import sys

from pyspark import cloudpickle

# Python workers need not find this package: its functions travel with the tasks that run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
