"""quern: refining and querying instruction-style text corpora as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors needn't have this package: functions sent to Python workers carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
