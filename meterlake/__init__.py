"""Usage, billing and health analytics for metered model access, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
