"""Training-data pipeline operators: fingerprints, classifiers, sharding, chat formatting,
decontamination, similarity joins, packing, URL filters, toxicity, language identification,
importance resampling, ranked search and token files.

Functions that run on executors are pickled by value, so a cluster needs numpy, pyarrow and
the tokenizer libraries on its workers, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
