"""gridloom: a Spark-native engine for sensor time-series and operator text.

Functions take and return DataFrames; nothing here owns a session.
"""

import sys

from pyspark import cloudpickle

# Arrow and pandas functions travel to executors by value, so a cluster needs
# no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
