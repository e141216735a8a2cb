"""Operators of a training-data pipeline: quality rules, source mixing, near-duplicate search,
toxicity and language models, tokenised output, line deduplication and sequence packing.

Nothing else in the library imports this subpackage. Its task functions travel to the
executors by value, so a job needs no installed copy of the package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
