"""Training-data operators: filtering, labelling, de-duplication, mixing, sharding and token output.

Nothing outside this subpackage imports it.  Every operator takes DataFrames, selects
only the columns it names, and returns DataFrames; intermediate tables that are read
more than once are written to the folder named by ``spark.checkpoint.dir``.
"""

import sys

from pyspark import cloudpickle

# Executors get the operators' Python code with each task; the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
