"""Time-series anomaly analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tidewatch.series import SeriesSpec, SeriesStats, over_series, series_stats, with_positions  # noqa: E402

__all__ = ["SeriesSpec", "SeriesStats", "over_series", "series_stats", "with_positions"]
