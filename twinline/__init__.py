"""twinline: parallel sentence-pair corpora as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions travel with the job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
