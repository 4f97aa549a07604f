"""docwarden: document-threat analytics as PySpark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# the few functions that run inside tasks travel with the job, so executors need no installation
register_pickle_by_value(sys.modules[__name__])
