"""Metric time series and logged text of training runs, as Spark DataFrames."""

__version__ = "0.1.0"
