"""Operators for training corpora: quality, sharding, decontamination, packing, privacy, copies, scoring, licences.

Each module holds one operator; ``queries`` registers them over the sample tables.
Functions of this package travel to the workers by value, so workers need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
