"""Spark-native analytics for keyed satellite time series."""
