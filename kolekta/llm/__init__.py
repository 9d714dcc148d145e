"""Training-data operators for text corpora (licences, quality, toxicity,
near-duplicates, decontamination, tokenisation, language-model scores,
nearest neighbours).

Functions of this package that run inside Spark tasks are pickled by value,
so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
