"""Segmentry: transcript-segment analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Workers may not have this repository on their path, so functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
