"""Tidewright: review-signal analytics and training-data operators written as Spark jobs."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
