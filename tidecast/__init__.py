"""Daily inventory time series on Spark: build, check, forecast, score, explain."""

__version__ = "0.1.0"
