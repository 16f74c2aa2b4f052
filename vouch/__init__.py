"""Evidence-scored listing analytics as PySpark DataFrame jobs.

The few Arrow functions of the package travel to the executors by value, so a cluster needs
no installation step.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
