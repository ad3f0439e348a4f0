"""Irregular-consumption analytics over smart-meter readings, as Spark DataFrame code."""

import sys

from pyspark import cloudpickle

# Functions that run inside Spark tasks travel by value, so executors need no install of
# this package (only numpy and pandas, which the pandas function APIs need anyway).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from wattsift.plans.analyze import Analysis, analyze  # noqa: E402
from wattsift.session import build_session  # noqa: E402

__all__ = ["Analysis", "analyze", "build_session"]
