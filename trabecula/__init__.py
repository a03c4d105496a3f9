"""Voxel-volume analytics on Spark: sparse voxel tables in, skeletons, scores and graphs out."""

import sys

from pyspark import cloudpickle

#: Functions go to the executors by value, so that these needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
