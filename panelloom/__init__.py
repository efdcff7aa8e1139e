"""panelloom: panel time-series analytics expressed as Spark DataFrame jobs.

A *panel* is a long DataFrame ``(series, ts, value)`` holding any number of
dated series. Raw rows are reduced to one row per series and day before any
ordered window runs, so no window partition can outgrow the calendar whatever
share of the raw rows one series holds.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
