"""Spark-native analytics over revision-tracked time series and large text corpora."""

__version__ = "0.1.0"
