"""Operators of a training-data pipeline: dedup, quality, scoring, PII, sharding, tokenizing, decontamination.

Every operator takes a DataFrame with at least ``doc_id`` and ``text`` and keeps its own general interface;
``queries.py`` derives the registered digest columns from them.  Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# what runs in Python workers travels with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
