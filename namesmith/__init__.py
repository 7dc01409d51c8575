"""namesmith: build and score "name this method" datasets with Spark."""

import sys

from pyspark import cloudpickle

# the few Python functions travel with their tasks: executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
