"""Training-data operators: filtering, deduplication, extraction and mixing of text corpora.

Nothing else in the library imports this subpackage. General Spark helpers come from
``kpiframe.session``; everything else an operator needs lives here.

Functions that run in tasks are sent by value, so the executors need not have this package
installed (only pyarrow, numpy, xxhash and zstandard).
"""

from pyspark.cloudpickle import cloudpickle

import kpiframe

cloudpickle.register_pickle_by_value(kpiframe)
